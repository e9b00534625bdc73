import re

import numpy as np

from lithoframe.llm import license_dice as ld


def brute(rows, templates=ld.TEMPLATES, t=0.8):
    out = {}
    for i, text in rows:
        if text is None:
            continue
        units = [("line", k, x) for k, x in enumerate(text.split("\n"))]
        parts = re.split(r"\n[ \t\r]*\n", text)
        if len(parts) > 1:
            units += [("paragraph", k, x) for k, x in enumerate(parts) if "\n" in x.strip(" ")]
        if "\n" in text:
            units.append(("document", 0, text))
        for u, k, x in units:
            own = set(ld.bigrams_of(x))
            for name, tpl in templates:
                b = set(ld.bigrams_of(tpl))
                d = 2 * len(own & b) / max(1, len(own) + len(b))
                if own and d >= t:
                    out[i, u, k, name] = max(d, out.get((i, u, k, name), 0))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        lines = [" ".join(rng.choice(["alpha", "under", "the", "mit", "license", "größe", "x"], int(rng.integers(0, 9)))) for _ in range(int(rng.integers(0, 5)))]
        for _ in range(int(rng.integers(0, 3))):
            w = ld.TEMPLATES[int(rng.integers(0, len(ld.TEMPLATES)))][1].split()
            for _ in range(int(rng.integers(0, 3))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(["", "foo", "THE", "*/"]))
            if rng.random() < 0.3 and len(w) > 12:
                w.insert(len(w) // 2, "\n * ")
                w += ["\n\n", "other"]
            lines.insert(int(rng.integers(0, len(lines) + 1)), ("# " if i % 2 else "") + " ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "license"), (903, "mit " * 300_000 + "\nReleased under the MIT License."), (904, "\n \n")]
    df = spark.createDataFrame([(*r, "z", "q") for r in rows], "doc_id long, text string, license string, unit string")
    got = {(r.doc_id, r.unit, r.place, r.license): r.dice for r in ld.find_licenses(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(got) > 200
    assert ld.find_licenses(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "Released under the MIT License.")] * 2, "doc_id long, text string")
    got = ld.find_licenses(df)
    assert [tuple(r) for r in got.collect()] == [(1, "line", 0, "MIT", 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
