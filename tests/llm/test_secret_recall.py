import random
import string

import pytest
import zstandard

from lithoframe.llm import secret_scan as ss

B64 = string.ascii_letters + string.digits
ALPHABETS = {"base64": B64 + "+/", "url": B64 + "_-", "alnum": B64, "lower": string.ascii_lowercase + string.digits, "base32": string.ascii_uppercase + "234567", "hex": "0123456789ABCDEF"}
PLACES = ("Authorization: Bearer {}\n", "the credential is {} as agreed", "pwd -> {}", "private_key\n{}\nend of it", 'bearer "{}",', "passphrase for the old box: <{}>")


def found(text):
    return [text[s:e] for s, _, e in ss.scan_text(text, ss.Novelty())[1]]


@pytest.mark.parametrize("signs", sorted(ALPHABETS))
def test_recall_on_planted_keys_that_no_base_kind_finds(signs):
    r, hits, all_ = random.Random(3), 0, 0
    for n in (18, 24, 32, 40, 64):
        for k in range(60):
            key = "".join(r.choices(ALPHABETS[signs], k=n)).strip("-=")
            text = "some words before it, as in any text. " * (k % 3) + PLACES[k % len(PLACES)].format(key) + " and more words follow."
            base = ss.base_spans(text, text.lower())
            if not any(text[a:b].endswith(key) for a, _, b in base):
                all_ += 1
                hits += any(key.startswith(f) or f in key for f in found(text))
    assert all_ > 250 and hits >= 0.97 * all_


def test_names_and_words_beside_sensitive_words_are_left():
    names = ["getUserAccessTokenFromRequest", "internationalisation", "my-credential-store-config", "AbstractSingletonProxyFactoryBean", "application_database_settings_local", "aaaaaaaaaaaaaaaaaaaaaaaa", "0000000000000000000000", "docs/authentication/overview.html"]
    for name in names:
        for place in PLACES:
            assert found(place.format(name)) == [], name


def test_added_bytes_are_those_of_a_dictionary_frame():
    novelty, key = ss.Novelty(), "q8Zr2LkT9xWv4NpB7mYc"
    text = f"first words here. Authorization: Bearer {key} then the rest of it"
    at = text.index(key)
    prime = (ss.IDENTIFIERS + text[at + len(key) :] + text[:at]).encode()
    d = zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    full = zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False).compress(key.encode())
    none = zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False).compress(b"")
    assert abs(novelty.added(text, at, at + len(key)) - (len(full) - len(none))) <= 1
    assert zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(full) == key.encode()
    name = "region request response secret"
    assert novelty.added(text.replace(key, name), at, at + len(name)) < 0.4 * len(name)
