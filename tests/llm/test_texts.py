"""Operators that look at one text at a time, and those that gather counts, against plain Python."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from terraloom.llm import fingerprints, private_data, quality_rules
from terraloom.llm._text import mix, slices, span_hash
from terraloom.llm.fingerprints import half_edits
from terraloom.llm.packing import optimal_bounds, pack
from terraloom.llm.token_counts import allocate, by_field, by_line, token_spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = ["", None, " ", "\n\n", "a", "é漢字 \U0001f600 x", "word " * 3000, "x" * 20000, "a b c a b c a b c", "same line here\nsame line here\n\n#*$%&|<> 1"]


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    later = [x for k, x in enumerate(lines) if x in lines[:k]]

    def covered(n, first):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        return {j for i, g in enumerate(grams) if (grams.count(g) > 1 if first else g in grams[:i]) for j in range(i, i + n)}

    repeat, dup = len(covered(3, True)), sum(map(len, later))
    grams = [sum(len(words[j]) for j in covered(n, False)) for n in quality_rules.GRAM_LIMITS]
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    # A share is over its limit by more than 1.64 standard errors of a share of so many words or lines.
    over = lambda share, items, limit: items > 0 and (share - limit) > 1.64 * (limit * (1 - limit) / items) ** 0.5
    bad = bool(lines) and (over(len(later) / len(lines), len(lines), 0.3) or over(dup / sum(map(len, lines)), len(lines), 0.2))
    bad = bad or any(over(g / sum(map(len, words)), len(words), limit) for g, limit in zip(grams, (0.15, 0.14, 0.13, 0.12, 0.11, 0.10), strict=True) if words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(later), repeat, dup, failed, not failed and not bad, grams)


def test_quality_measures(spark, documents):
    rng = random.Random(2)
    texts = [t for t in EDGE if not t or len(t) < 9000] + [" ".join(rng.choices(["a", "bb", "c\n", "dé"], k=rng.randint(0, 40))) for _ in range(60)]
    for n in range(60):  # texts near the limits: some words of their own, and a passage or lines that come again
        own = [f"w{rng.random()}" for _ in range(rng.randint(40, 120))]
        again = own[: rng.randint(1, 24)]
        texts.append((" ".join(own) + " | " + " ".join(again)) if n % 2 else "\n".join(own + again + ["x"]))
    rows = list(enumerate(texts)) + [(1, "twice"), (None, "no id")]
    got = {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.dup_line_chars, r.base_failed, r.kept, tuple(r.dup_gram_chars)) for r in quality_rules.measure(documents(rows)).collect()}
    for i, t in rows:
        *plain, grams = plain_quality(t)
        assert (i, *plain, tuple(grams)) in got, t
    verdicts = {(r.base_failed, r.kept) for r in quality_rules.measure(documents(rows)).collect()}
    assert verdicts == {(True, False), (False, True), (False, False)}
    short = [(1, "\n".join(f"{k} " + "x y z u v w " * (k == 0) + " ".join(f"w{k}{j}" for j in range(30)) for k in range(2)) + "\n0"), (2, "\n".join(["p q r s t u"] + [f"v{k} w{k} x{k} y{k} z{k}" for k in range(12)] + ["p q r s t u"]))]
    assert {r.doc_id: r.kept for r in quality_rules.measure(documents(short)).collect()} == {1: True, 2: True}  # a few words that come again are no verdict on a short text
    kept = quality_rules.keep(documents(rows + [(900, " ".join(f"w{k}" for k in range(60)))]))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, t in rows if plain_quality(t)[-2]] + [900] and kept.columns == documents(rows).columns
    assert quality_rules.measure(documents([])).count() == 0


def test_slices_cover_whole_columns(monkeypatch):
    monkeypatch.setattr("terraloom.llm._text.SLICE_BYTES", 7)
    texts = ["", "abc de", None, "f", "", "long long long text", "é é"]
    words = []
    for s in slices(pa.array(texts)):
        a, b, row = s.words()
        words += [(s.first + r, bytes(s.data[x:y]).decode()) for x, y, r in zip(a, b, row, strict=True)]
    assert words == [(k, w) for k, t in enumerate(texts) for w in WORD.findall(t or "")]
    lines = [(s.first + r, bytes(s.data[x:y]).decode()) for s in slices(pa.array(["a\n", "", "\nb", "c"])) for x, y, r in zip(*s.lines(), strict=True)]
    assert lines == [(0, "a"), (0, ""), (1, ""), (2, ""), (2, "b"), (3, "c")]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    parts = ["a.b@c.de", "@", "x@y", ".com", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "+1 (656) 555-6510", "+", "(", " ", "-", "378282246310005", "é", "\n", "0", "9999"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert private_data.base_spans(text) == plain_spans(text), text
    assert private_data.base_spans("a" * 200_000 + " 1" * 50_000 + "1" * 200_000 + "@") == []


def test_disclosing_terms(spark, documents):
    rows = [(0, "Zanzibar lodge answers a.b@c.de today with pleasure"), (1, "write Zanzibar or a.b@c.de instead"), (2, "the lodge answers nobody"), (3, "today with pleasure nobody answers"), (4, None), (4, ""), (5, "Zanzibar lodge answers a.b@c.de today with pleasure")]
    got = {r.doc_id: r for r in private_data.find(documents(rows)).collect()}
    assert got[1].all_spans == ["term:6:14", "email:18:26"] and got[1].base == ["email:18:26"]
    assert got[0].all_spans[0] == "term:0:8" and got[2].all_spans == [] and (got[0].n_email, got[4].n_email) == (1, 0)
    clean = private_data.sanitise(documents(rows))
    assert clean.columns == documents(rows).columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts[1] == ("write [TERM] or [EMAIL] instead", 31) and texts[2][0] == rows[2][1]
    assert private_data.find(documents([])).count() == 0


@pytest.mark.parametrize("broadcast", [2_000_000, 0])
def test_terms_are_marked_in_every_text(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(private_data, "BROADCAST_TERMS", broadcast, raising=False)
    rows = [(0, "Zanzibar answers a.b@c.de"), (1, "write Zanzibar or a.b@c.de"), (2, "from a.b@c.de\nabout the ZANZIBAR"), (3, "to Zanzibar, by zanzibar"), (4, "nobody here"), (5, None), (6, "Twice x.y@z.de x.y@z.de"), (7, "Twice upon x.y@z.de"), *[(k, "Twice") for k in range(8, 12)]]
    got = {r.doc_id: r.all_spans for r in private_data.find(documents(rows)).collect()}
    assert len(got) == len(rows) and got[2] == ["email:5:13", "term:24:32"] and got[3] == ["term:3:11", "term:16:24"]
    assert got[4] == got[5] == [] and all(got[k] == [] for k in range(8, 12)) and not any(x.startswith("term") for x in got[6])  # 2 of 6 lines, however often the entity stands in one
    texts = {r.doc_id: (r.text, r.n_chars) for r in private_data.sanitise(documents(rows)).collect()}
    assert texts[2][0] == "from [EMAIL]\nabout the [TERM]" and texts[3] == ("to [TERM], by [TERM]", 20) and texts[4][0] == rows[4][1] and texts[5] == (None, None)


def test_token_spans_against_another_library():
    from tokenizers import Tokenizer

    other = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    other.encode_special_tokens = True
    for text in [t or "" for t in EDGE] + ["a\n \n b", "<|endoftext|>", "naïve—“quoted” 12,345"]:
        ids, a, b = token_spans(text)
        e = other.encode(text, add_special_tokens=False)
        assert list(ids) == e.ids and list(zip(a.tolist(), b.tolist(), strict=True)) == e.offsets


def test_allocation_rules():
    starts, ends, bounds = np.array([0, 2, 5]), np.array([2, 5, 9]), np.array([0, 3, 3, 9])
    assert [allocate(starts, ends, bounds, r)[0].tolist() for r in ("first", "last", "majority")] == [[2, 0, 1], [1, 0, 2], [1, 0, 2]]
    assert allocate(starts, ends, bounds, "first")[1].tolist() == [1, 0, 1]


def test_counts_by_section(spark, documents):
    rows = list(enumerate(EDGE)) + [(None, "no id")]
    got = by_line(documents(rows)).groupBy("doc_id").sum("n_tokens").collect()
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        assert r[1] == len(token_spans(text)[0])
    assert by_line(documents([(1, "a\n\nb")])).count() == 3
    r = by_field(documents([(1, "some text")]), ["lang", "source", "text"]).first()
    assert r.total == len(token_spans("en\ns\nsome text")[0]) == sum(r.tokens.values())
    with pytest.raises(ValueError):
        by_line(documents(rows), "best")


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lengths = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        n, k = rng.integers(1, 9, len(lengths)), int(rng.integers(1, 5))
        pad = lambda bounds: sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, n, strict=True))
        bounds, cost = optimal_bounds(lengths, n, lengths * n, k)
        assert len(bounds) <= k and pad(bounds) == cost == min(pad((*cut, lengths[-1])) for m in range(min(k, len(lengths))) for cut in combinations(lengths[:-1], m))
    assert optimal_bounds(np.array([]), np.array([]), np.array([])) == ([], 0)


def test_packing(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(20000), rng.randrange(300)) for _ in range(800)] + [(None, 5), (None, 5), (7, 100_000), (8, 0)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 4, 1000).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted(rows, key=repr)
    by_bucket = {}
    for r in got:
        by_bucket.setdefault((r.bucket, r.bound), []).append(r)
    below = -1
    for (_, bound), members in sorted(by_bucket.items()):
        assert all(below < r.n_tokens <= bound for r in members)
        below, size = bound, max(1, 1000 // max(bound, 1))
        members.sort(key=lambda r: (r.batch, r.place))
        assert [(r.batch, r.place) for r in members] == [divmod(k, size) for k in range(len(members))]
        assert [r.doc_id or -1 for r in members] == sorted(r.doc_id or -1 for r in members)
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_packing_of_scattered_and_repeated_ids(spark):
    rng = random.Random(8)
    rows = [(rng.getrandbits(62), rng.randint(0, 9)) for _ in range(300)] + [(None, 3)] * 5 + [(7, 4)] * 6 + [(7, 2)]
    got = pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 3, 40).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in got) == sorted((i or -1, n) for i, n in rows)
    for bucket in {r.bucket for r in got}:
        mine = sorted((r for r in got if r.bucket == bucket), key=lambda r: (r.batch, r.place))
        size = max(1, 40 // max(1, mine[0].bound))
        assert [(r.batch, r.place) for r in mine] == [(k // size, k % size) for k in range(len(mine))]
        order = [(r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in mine]
        assert order == sorted(order)
    assert pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_padding_is_least_for_long_texts(spark):
    rng = random.Random(6)
    for low, high in ((8200, 8320), (4000, 12_000), (40_000, 40_600)):
        lengths = [rng.choice(range(low, high)) for _ in range(12)] + [10, 20]
        got = pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long"), 4, 100_000).collect()
        cuts = (sorted((*cut, max(lengths))) for m in range(4) for cut in combinations(sorted(set(lengths))[:-1], m))
        assert sum(r.bound - r.n_tokens for r in got) == min(sum(min(b for b in cut if b >= x) - x for x in lengths) for cut in cuts)


def test_half_edits(spark, documents):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    own = [" ".join(word() for _ in range(rng.randint(0, 80))) for _ in range(40)]
    rows = [(k * 997, t) for k, t in enumerate(own)] + [(40 * 997, own[3]), (41 * 997, None), (42 * 997, "é")]
    got = {r.doc_id: r for r in half_edits(documents(rows)).collect()}
    for k, (i, t) in enumerate(rows):
        t, following = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and (r.near_edited == 1) >= (edited == t)
        assert (r.fingerprint == got[rows[(k + 1) % len(rows)][0]].fingerprint) == (r.near_next == 1)
    assert got[3 * 997].fingerprint == got[40 * 997].fingerprint
    alone = half_edits(documents([(5, "one row only")])).first()
    assert alone.near_next == 1.0
    assert half_edits(documents([])).count() == 0


def test_every_term_in_the_band_counts(spark, documents, monkeypatch):
    group = lambda k: " ".join(f"g{k}{c}" for c in "abcdef")
    docs = documents([(k, f"a few common words {group(k // 20)} own{k}") for k in range(200)] + [(200, None), (201, "common words a few")])
    got = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert len(got) == 202 and len(set(got.values())) == 202
    edits = sorted(map(tuple, half_edits(docs).collect()))
    monkeypatch.setattr(fingerprints, "MAX_LEXICON", 0)  # the lexicon joins by a shuffle
    assert {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()} == got
    assert sorted(map(tuple, half_edits(docs).collect())) == edits


def plain_prints(texts):
    """Fingerprint parts of each text by loops over its terms."""
    one = lambda x: int(mix(np.array([x % (1 << 64)], np.uint64))[0])
    terms = [sorted(set(WORD.findall((t or "").translate({k: k + 32 for k in range(65, 91)})))) for t in texts]
    names = sorted({x for t in terms for x in t})
    s = next(slices(pa.array(names)))
    number = dict(zip(names, map(int, span_hash(s.prefix(), s.bounds[:-1], s.bounds[1:])), strict=True))
    df = {x: sum(x in t for t in terms) for x in names}
    band = {x for x in names if len(texts) / 2**fingerprints.HIGH_BITS <= df[x] <= len(texts) / 2**fingerprints.LOW_BITS}
    wide = fingerprints.SUBSETS
    out = []
    for t in terms:
        parts = [0] * wide
        for k in range(wide):
            if k < fingerprints.SHARES:
                mine = [x for x in t if x in band and one(number[x] + 977 * wide + 1) % fingerprints.SHARES == k]
            else:
                rate = 5 + (k - fingerprints.SHARES) // 7
                mine = [x for x in t if x in band and one(number[x] + 977 * (k - fingerprints.SHARES) + 1) < 1 << (64 - rate)]
            if mine:
                parts[k] = (one(sum(one(number[x] + k) for x in mine)) | 1 << 48) >> 48
        if t and not any(parts):
            parts = [(one(sum(one(number[x]) for x in t) + k) | 1 << 48) >> 48 for k in range(wide)]
        out.append(parts)
    return out


def test_fingerprints_against_a_plain_version(spark, documents):
    rng = random.Random(12)
    words = [f"t{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(300)], k=rng.randint(0, 50))) for _ in range(120)] + [None, "Ab aB", "rare one", "x" * 9000]
    rows = [(rng.getrandbits(60), t) for t in texts]
    rows.sort()
    prints = plain_prints([t for _, t in rows])
    text = lambda parts: "".join(f"{p:04x}" for p in parts)
    got = {r.doc_id: r for r in half_edits(documents(rows)).collect()}
    for k, (i, _) in enumerate(rows):
        own, then = prints[k], prints[(k + 1) % len(rows)]
        assert got[i].fingerprint == text(own)
        filled = sum(bool(a or b) for a, b in zip(own, then, strict=True))
        same = sum(a == b and a > 0 for a, b in zip(own, then))
        assert abs(got[i].near_next - (1.0 if own == then else same / filled)) < 1e-12


def test_next_documents_of_null_and_repeated_ids(spark, documents):
    rows = [(None, "no id"), (None, None), (1, "same same"), (1, "same same"), (1, "other"), (2, "last")]
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_chars) for r in half_edits(documents(rows)).collect()))
    assert got == sorted(((i is not None, i or 0, len(t or "")) for i, t in rows))
