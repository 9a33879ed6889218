import random

import pytest
from tokenizers import Tokenizer

from seqrank.llm.bpe import ByteBPE, decode, encode, op5_bpe, round_trip
from seqrank.llm.common import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def cases():
    rng = random.Random(1)
    pool = "ab Z9'\n\t  sdtrevmlé\u3000\x85\x1c\u200b\u0301\U0001f600٣中\x00,.!"
    texts = ["", " ", "a<|endoftext|> b <|endoftext|><|endoftext|>", "it's we'll", "aaaaaaaaaa " * 50, "z" * 5000, "x " * 20_000]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    return texts + ["".join(map(chr, range(k, k + 97))) for k in range(0, 0x3000, 97)]


def test_ids_and_texts_are_the_librarys(spark):
    library = Tokenizer.from_file(PATH)
    texts = [*cases(), None]
    df = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, ids string")
    ids = {r["doc_id"]: r["ids"] for r in encode(df).collect()}
    assert ids == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in decode(encode(df)).collect()}
    assert back == {k: library.decode(ids[k], skip_special_tokens=False) for k in ids}


def test_ids_that_are_no_text_decode_as_the_library_does(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    lists = [[rng.randrange(0, 300) for _ in range(rng.randrange(0, 20))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in decode(df).collect()} == {k: library.decode(x, skip_special_tokens=False) for k, x in enumerate(lists)}


def test_memo_is_bounded_and_forgets_nothing_in_use():
    bpe, library = ByteBPE(PATH, 20), Tokenizer.from_file(PATH)
    for t in cases()[:200]:
        (raw,) = bpe.encode_batch([t])
        assert len(raw) // 4 == len(library.encode(t, add_special_tokens=False).ids)
        assert len(bpe.memo) <= 20 + len(t) + 1


def test_query_over_a_table(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (None, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r["n_tokens"] for r in op5_bpe(spark, str(tmp_path)).collect()}
    assert rows[None] == 0 and rows[1] == 2


def test_empty_tables_and_repeated_rows(spark, documents):
    assert encode(documents([])).collect() == [] and round_trip(documents([])).collect() == []
    long = "word " * 60_000 + "é" * 1000
    rows = round_trip(documents([(1, "twice"), (1, "twice"), (2, ""), (3, long)])).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 2, 3]
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {i: len(Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids) for i, t in ((1, "twice"), (2, ""), (3, long))}


def test_a_vocabulary_out_of_order_is_refused(tmp_path):
    spec = '{"model": {"vocab": {%s}, "merges": ["ab c", "a b"]}}'
    from seqrank.llm.bpe import byte_symbols

    vocab = {c: k for k, c in enumerate(byte_symbols())} | {"ab": 256, "abc": 257}
    import json

    (tmp_path / "v.json").write_text(spec % json.dumps(vocab)[1:-1])
    with pytest.raises(ValueError):
        ByteBPE(str(tmp_path / "v.json"))
