import random

from terraloom.llm.sentence_pieces import MODEL, decode, decode_ids, encode, encode_batch, round_trip


def texts():
    rng = random.Random(6)
    out = ["", None, " ", "  a  b ", "日本語 text\n\n\nemoji 👩‍👩‍👧 x\n", "a" * 2000, "the" * 300, " " * 100, "\t\tx", "a▁b", "<0x0A> </s>", "0123456 99"]
    out += ["".join(rng.choice("abcdeth inorSéł中    \n.,1209-=()\U0001f600") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return out + ["".join(rng.choice("abethin=-") for _ in range(rng.randint(300, 900))) for _ in range(8)]


def test_ids_and_texts_equal_the_library_s():
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    said = texts()
    for t, ids in zip(said, encode_batch(said), strict=True):
        assert ids.tolist() == other.encode(t or "")
        assert decode_ids(ids) == other.decode(ids.tolist())
    ids = [0xE6 + 3, 300, 1, 2, 0, 400]
    assert decode_ids(__import__("numpy").array(ids)) == other.decode(ids)


def test_operators(spark, documents):
    rows = list(enumerate(texts()[:30])) + [(None, "no id"), (3, "again")]
    docs = documents(rows)
    back = sorted(((r.doc_id, r.text) for r in decode(encode(docs)).collect()), key=repr)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=repr)
    assert all(r.exact == ("▁" not in (dict(rows)[r.doc_id] or "")) for r in round_trip(docs).collect() if r.doc_id != 3)
    assert encode(documents([])).count() == 0
