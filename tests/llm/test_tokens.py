import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_cases import ODD, documents as frame
from tidemark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = tokens.TextEncoder(PATH)


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'s<|>!e\x1c\xa0é1²_"), st.characters(codec="utf-8")), max_size=40))
def test_words_give_the_ids_of_the_whole_text(text):
    assert ENCODER.encode(pa.array([text, "x", text + " y"]))[0].tolist() == ids(text) + ids("x") + ids(text + " y")


def test_special_token_text():
    text = "a <|endoftext|> b<|endoftext|>, c"
    assert ENCODER.encode(pa.array([text, "x", text + " y"]))[0].tolist() == ids(text) + ids("x") + ids(text + " y")


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(frame(spark, ODD, extra=True), path, PATH, end_id=0)
    rows = tokens.token_digests(spark, path).orderBy("start").collect()
    assert len(rows) == len(ODD)
    # nulls first, then ascending ids
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.input_ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.input_ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted((str(i), ids(t) + [0]) for i, t, *_ in ODD)
    assert sorted((str(r.doc_id), r.input_ids) for r in rows) == want
    some = tokens.read_tokens(spark, path, first=8, last=9)
    assert sorted(r.doc_id for r in some.collect()) == [8, 9]
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,8)" in plan
    meta = tokens.read_metadata(spark, path)
    assert "input_ids" not in meta._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.start, r.n_tokens) for r in meta.collect()) == sorted((r.start, r.n_tokens) for r in rows)


def test_file_format(spark, tmp_path):
    path = str(tmp_path / "tokens")
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> string(hash(id, i)))) AS text")
    tokens.write_tokens(docs.coalesce(1), path, PATH)
    files = [pq.ParquetFile(f) for f in glob.glob(path + "/*.parquet")]
    columns = [f.metadata.row_group(g).column(c) for f in files for g in range(f.metadata.num_row_groups)
               for c in range(f.metadata.num_columns)]
    lists = [c for c in columns if "input_ids" in c.path_in_schema]
    assert lists and all({"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(c.encodings) for c in lists)
    assert all(c.has_column_index and c.has_offset_index for c in columns if "input_ids" not in c.path_in_schema)


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "tokens")
    tokens.write_tokens(frame(spark, []), path, PATH)
    assert tokens.token_digests(spark, path).count() == 0
    assert tokens.read_metadata(spark, path).count() == 0


def test_digests_go_back_in_small_pieces_and_the_encoder_is_let_go():
    sizes = [0, 3, 1, 0, 9, 2, 2, 0, 1]
    lists = pa.array([list(range(n)) for n in sizes], pa.list_(pa.int32()))
    batch = pa.record_batch({"shard": pa.array([0] * 9, pa.int32()), "doc_id": pa.array(range(9), pa.int64()), "shard_start": pa.array(range(9), pa.int64()),
                             "n_tokens": pa.array(sizes, pa.int64()), "input_ids": lists})
    for b, n in ((batch, sizes), (batch.slice(2, 5), sizes[2:7]), (batch.slice(0, 0), [])):
        parts = [p.column("input_ids").to_pylist() for p in tokens._id_slices(b, 4)]
        assert [len(x) for p in parts for x in p] == n and all(len(p) == 1 or sum(map(len, p)) <= 4 for p in parts)
    tokens._encoder(PATH)
    many = pa.ListArray.from_arrays(pa.array([0, 1 << 18, 1 << 19, (1 << 19) + 5], pa.int32()), pa.array(np.arange((1 << 19) + 5, dtype=np.int32)))
    whole = pa.record_batch({**{c: batch.column(c).slice(0, 3) for c in ("shard", "doc_id", "shard_start", "n_tokens")}, "input_ids": many})
    out = list(tokens._digest([whole]))
    assert not tokens._ENCODERS and len(out) == 3
    assert [c for b in out for c in b.column("ids_crc32").to_pylist()] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in many.to_pylist()]
