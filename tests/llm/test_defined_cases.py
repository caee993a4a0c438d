"""Defined cases of operators that have their main tests elsewhere."""

from terraloom.llm import sentence_pieces
from terraloom.llm.sentence_pieces import MODEL, decode_ids, encode_batch
from terraloom.llm.token_counts import by_field, by_line


def test_token_counts_of_empty_tables_and_repeated_rows(spark, documents):
    rows = [(1, "two lines\nof text"), (1, "two lines\nof text"), (None, "x"), (2, None), (3, "")]
    for count in (by_line, lambda d: by_field(d, ["lang", "text"])):
        found = count(documents(rows))
        same = [tuple(r) for r in found.where("doc_id = 1").collect()]
        assert len(same) % 2 == 0 and all(same.count(r) % 2 == 0 for r in same)
        assert found.where("doc_id IS NULL").count() > 0
        assert count(documents(rows).limit(0)).count() == 0


def test_a_text_longer_than_a_slice(monkeypatch):
    import sentencepiece

    monkeypatch.setattr(sentence_pieces, "SLICE_CHARS", 500)
    said = ["A sentence of several words, 12 of them. " * 60, "", "short"]
    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t, ids in zip(said, encode_batch(said), strict=True):
        assert ids.tolist() == other.encode(t) and decode_ids(ids) == t
