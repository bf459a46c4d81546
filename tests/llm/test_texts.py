"""Personal data, token counts and SimHash against brute force, with their edge cases."""

import re

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tidemark.llm import graph, pii, simhash, tokencount
from tokenizers import Tokenizer

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub(r"\D", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(digits[::-1])]
            luhn = sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@-+ 0()%é", max_size=40))
def test_base_spans(text):
    assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE] == brute_pii(text)


def test_added_spans_and_context():
    iban = "DE89 3704 0044 0532 0130 00"
    assert ("iban", 5, 5 + len(iban), 1.0) in pii.spans_of(f"IBAN {iban}.")
    assert not [s for s in pii.spans_of("DE88 3704 0044 0532 0130 00") if s[0] == "iban"]
    assert not [s for s in pii.spans_of("FE5949719B6B82BC439E9329B") if s[0] == "iban"]
    assert [s[0] for s in pii.spans_of("my SSN is 123-45-6789")] == ["ssn"]
    assert not pii.spans_of("part 123-45-6789")
    card = pii.spans_of("4111 1111 1111 1111")[0]
    assert card[:3] == ("card", 0, 19) and pii.spans_of("visa 4111111111111111")[0][3] > card[3]
    assert pii.spans_of("a" * 200_000 + "@") == [] and pii.spans_of("1" * 200_000 + ".") == []


def test_context_flips_a_result():
    kinds = lambda x: [s[0] for s in pii.spans_of(x)]
    iban = "DE89370400440532013000"
    assert kinds(f"{iban} is ours") == ["iban"] and kinds(f"serial {iban} is ours") == [] and kinds(f"serial of the bank {iban}") == ["iban"]
    assert kinds("call 030 555 1234 now") == ["local_phone"] and kinds("gate 030 555 1234 now") == []
    assert kinds("call about order 030 555 1234") == [] and kinds("recall 030 555 1234") == []
    assert kinds("account 123456789") == ["account"] and kinds("total 123456789") == [] and kinds("account, invoice 123456789") == []
    assert kinds("my SSN 123-45-6789, no invoice") == [] and kinds("call +49 (030) 555-7713") == ["phone"]
    assert kinds("bank card 4111 1111 1111 1111") == ["card"] and kinds("server 10.0.0.1 call it") == ["ip"]
    low, plain, high = (pii.spans_of(x)[0][3] for x in ("release 10.0.0.1", "at 10.0.0.1", "server 10.0.0.1"))
    assert low < plain < high and low == 0.4


def test_every_country_of_the_registry():
    """An IBAN with the right check digits is found in each country, and not with others or another length."""
    for country, length in pii.IBAN_LENGTH.items():
        body = "1" * (length - 4)
        rest = int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        iban = f"{country}{98 - rest:02d}{body}"
        assert [x[:3] for x in pii.spans_of(f"iban {iban} ok") if x[0] == "iban"] == [("iban", 5, 5 + length)], country
        assert not [x for x in pii.spans_of(f"iban {country}{(98 - rest) % 97 + 1:02d}{body}") if x[0] == "iban" and (98 - rest) % 97 + 1 != 98 - rest]
        assert not [x for x in pii.spans_of(f"iban {iban}1") if x[0] == "iban"]


def test_query_has_scores(spark):
    from tidemark.llm import queries

    rows = queries.op6_pii(spark, "/root/testdata/sf0.001").collect()
    assert any(r.scores for r in rows)
    assert list(rows[0].asDict())[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert all(len(r.scores.split(",")) == len(r.spans.split(",")) for r in rows)


def test_find_and_redact(make):
    docs = make([(1, None), (2, ""), (3, "mail a@b.co, call +1 (017) 555-7713 now"), (3, "mail a@b.co"), (None, "10.0.0.256 10.0.0.1")])
    got = {(r.doc_id, r.text): [tuple(s)[:3] for s in r.spans] for r in pii.find_pii(docs, keep_text=True).collect()}
    assert got == {
        (1, ""): [], (2, ""): [], (3, "mail [EMAIL], call [PHONE] now"): [("email", 5, 11), ("phone", 18, 35)],
        (3, "mail [EMAIL]"): [("email", 5, 11)], (None, "10.0.0.256 [IP]"): [("ip", 11, 19)],
    }
    assert pii.find_pii(make([])).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


TRICKY = [None, "", " ", "  \n\n x", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>", "don't we'll I'M", "x\x1c\x85 　y᠎", "é" * 300, "ab" * 4000, "1" * 100, "\U0001f600‍½²", "word " * 3000]


def test_token_counts(spark, make, vocabulary):
    path, library = vocabulary
    rows = [(k, x) for k, x in enumerate(TRICKY)] + [(0, None), (None, "null id")]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tokencount.token_counts(make(rows), path).collect())
    assert got == sorted((str(k), len((x or "").encode()), len(library.encode(x or "", add_special_tokens=False).ids)) for k, x in rows)
    assert tokencount.token_counts(make([]), path).count() == 0


def test_whole_tokens_are_proven(vocabulary):
    path, library = vocabulary
    proven = tokencount.Merger(path).whole()
    some = sorted(proven)[::50]
    pieces = regex.compile(tokencount.PATTERN)
    assert len(proven) > 40_000
    assert all(len(e.ids) == 1 for x, e in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True) if pieces.findall(x) == [x])


def test_memo_is_bounded(vocabulary, monkeypatch):
    monkeypatch.setattr(tokencount, "MEMO", 3)
    merger = tokencount.Merger(vocabulary[0])
    counts = tokencount.PieceCounts({"a": 1}, merger)
    assert [counts[x] for x in ["qzx", "zzqj", "xxkq", "qqqz", "qzx"]] == [merger.count(x) for x in [b"qzx", b"zzqj", b"xxkq", b"qqqz", b"qzx"]]
    assert len(counts) <= 4


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉ \n\x1c ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_long_text():
    text = "Some words, \t and more of them\n" * 60_000
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**64, 300, dtype=np.uint64)
    mine = lambda x: set(simhash.anchors(np.array([x], np.uint64))[0].tolist())
    for x in fps.tolist():
        i, j = rng.integers(0, 64, 2).tolist()
        found = mine(x)
        assert len(found) in (1, 32) and all(((a ^ x) & simhash.LOW).bit_count() <= 2 for a in found)
        assert found & mine(x ^ (1 << i)) and found & mine(x ^ (1 << i | 1 << j))


def components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, k) for k in range(1001, 1100)]
    edges = [*chain, *star, (5, 5), (2000, 1999), (1999, 2001)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = components(edges, {x for e in edges for x in e})
    assert got == {n: r for n, r in want.items() if n != r}
    assert graph.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates(spark, make, monkeypatch):
    rng = np.random.default_rng(3)
    base = " ".join(f"w{k}" for k in rng.integers(0, 5000, 400))
    rows = [(5, base), (9, base), (2, base.upper()), (7, None), (1, ""), (3, " \n"), (None, ""), (20, "one"), (21, "one two"), (21, "one two")]
    words = base.split()
    for k in range(30, 60):  # near copies, some within two bits of one another
        copy = list(words)
        copy[int(rng.integers(0, 400))] = "other"
        rows.append((k, " ".join(copy)))
    got = simhash.near_duplicates(make(rows)).collect()
    fps = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = components(links, range(len(rows)))
    least = {}
    for k, r in comp.items():
        if rows[k][0] is not None:
            least[r] = min(least.get(r, 10**9), rows[k][0])
    want = sorted(((rows[k][0], fps[k], least[comp[k]]) for k in range(len(rows))), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert len({w[2] for w in want if w[0] is not None and w[0] >= 30}) < 30
    kept = simhash.keep_one_per_group(make(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({w[2] for w in want})
    assert kept.columns == make(rows).columns and simhash.near_duplicates(make([])).count() == 0


def test_large_cluster_at_one_anchor():
    anchor = 0
    members = sorted({anchor, *(1 << i for i in range(63)), *(1 << i | 1 << j for i in range(63) for j in range(i))})
    edges = simhash.cluster(np.array(members, np.int64))
    assert len(edges) == len(members) - 1 and {r for _, r in edges} == {0}
