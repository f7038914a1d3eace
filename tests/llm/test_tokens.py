"""Token operators against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cellweave.llm import packing, sentencepiece_bpe, token_counts, token_files
from cellweave.llm.common import parts_for
from cellweave.llm.pretoken import PretokenTable
from cellweave.llm.queries import vocabulary

BYTE, WORD, PIECE = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [*"abcXYZ éßÀçñ'’“…\n\t\r  12.,!?#%_-+|<>", "'s", "'ll", "<|endoftext|>", "İ", "ſ", "²", "\xa0", "\x0b", "\x1c", "日本", "́", "ǅ", "µ", "the", "ing", "▁", "  ", "==", "😀", "\x00"]


def texts(n=2000, most=25):
    rng = random.Random(7)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, most))) for _ in range(n)]


def pairs(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pretoken_tables_give_the_librarys_ids(path):
    table, library = PretokenTable(path), Tokenizer.from_file(path)
    cases = texts()
    flat, sizes = table.encode_many(cases)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in cases]
    counting = PretokenTable(path, counts_only=True)
    assert counting.count_many(cases) == sizes.tolist()
    # By pre-tokens alone, for every text: no text is encoded whole.
    assert [counting.odd_count(t) for t in cases] == sizes.tolist()


def test_merge_rounds_give_the_librarys_ids():
    model = sentencepiece_bpe.PieceModel(PIECE)
    cases = [*texts(), " " * 5000, "=-" * 2500, "q" + " " * 900 + "z", "th" * 900]
    assert [x.tolist() for x in model.encode_many(cases)] == model.library.encode(cases, add_bos=True, add_eos=True)


def test_merge_rounds_equal_the_heap():
    model = sentencepiece_bpe.PieceModel(PIECE)
    for word in ("▁international", "▁▁▁▁▁▁▁", "aaaaaaaa", "▁thethethe"):
        assert model.encode_words([word])[0].tolist() == model._heap(model._symbols(word))


def test_sentencepiece_digests(docs, edge):
    library = sentencepiece_bpe.PieceModel(PIECE).library
    for df in (docs, edge):
        expected = []
        for i, t in pairs(df):
            ids = library.encode(t, add_bos=True, add_eos=True)
            expected.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        assert sorted(map(tuple, sentencepiece_bpe.digests(df, PIECE).collect()), key=str) == sorted(expected, key=str)


def test_encode_returns_ids_and_text(edge):
    rows = sentencepiece_bpe.encode(edge.where("doc_id in (1, 7)"), PIECE).orderBy("doc_id").collect()
    assert rows[0]["ids"] == [1, 2] and rows[0]["decoded"] == ""
    assert "日本語" in rows[1]["decoded"]


def test_token_counts(docs, edge):
    library = Tokenizer.from_file(BYTE)
    for df in (docs, edge):
        expected = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in pairs(df)]
        assert sorted(map(tuple, token_counts.token_counts(df, BYTE).collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", ["docs", "edge"])
def test_packing_is_a_gapless_partition_of_all_ids(name, request):
    df, library = request.getfixturevalue(name), Tokenizer.from_file(BYTE)
    rows = packing.pack(df.repartition(3), BYTE, window=128).collect()
    sequences = {}
    for r in rows:
        assert r["length"] > 0 and len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(sum(n for _, n in own) < 128 for own in sequences.values()) <= 1
    # Each document's pieces, by start, give its ids and the end id.
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], bytes(r["ids"]), r["doc_tokens"]) for r in rows)
    expected = sorted((i if i is not None else -1, np.asarray([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in pairs(df))
    by_doc = {}
    for i, _, ids, n in got:
        by_doc.setdefault(i, [[], n])[0].append(ids)
    totals = {}
    for i, ids in expected:
        totals[i] = totals.get(i, 0) + len(ids)
    assert {i: sum(map(len, own[0])) for i, own in by_doc.items()} == totals
    single = {i: ids for i, ids in expected if [j for j, _ in expected].count(i) == 1}
    assert all(b"".join(by_doc[i][0]) == ids and by_doc[i][1] * 4 == len(ids) for i, ids in single.items())


def test_token_files_round_trip(docs, edge):
    library = Tokenizer.from_file(WORD)
    for df in (docs, edge):
        files = token_files.write_token_files(df.repartition(3), WORD, partitions=3)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_digests(files).collect())
        crc = lambda t: [(len(ids := [*library.encode(t, add_special_tokens=False).ids, 1])), zlib.crc32(np.asarray(ids, "<u4").tobytes())]
        assert sorted(((i, n, c) for _, i, n, c in got), key=str) == sorted(((i, *crc(t)) for i, t in pairs(df)), key=str)
        at = 0
        order = []
        for start, i, n, _ in got:
            assert start == at
            at += n
            order.append(-1 if i is None else i)
        assert order == sorted(order)


def test_token_files_have_page_indexes_and_dictionaries(docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    token_files.ordered_ids(docs, WORD, 1, 2).write.options(**{k: str(v) for k, v in token_files.WRITER.items()}).parquet(str(tmp_path / "f"))
    file = pq.ParquetFile(sorted(glob.glob(str(tmp_path / "f/*.parquet")))[0])
    columns = {file.metadata.row_group(0).column(k).path_in_schema: file.metadata.row_group(0).column(k) for k in range(file.metadata.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert any("DICTIONARY" in e for e in ids.encodings) and columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index
    assert any("DELTA" in e for e in columns["n_tokens"].encodings)


def test_token_files_are_the_same_on_every_run(spark):
    rows = [(k % 3, f"text {k * 7919 % 100}") for k in range(90)] + [(1, None), (1, None)]
    runs = []
    for parts in (5, 2):
        df = spark.createDataFrame(rows[::-1] if parts == 2 else rows, "doc_id long, text string").repartition(parts)
        files = token_files.write_token_files(df, WORD, partitions=3)
        runs.append(sorted(tuple(r) for r in token_files.read_digests(files).collect()))
    assert runs[0] == runs[1]


def test_selective_reads_of_token_files(spark, docs):
    library = Tokenizer.from_file(WORD)
    files = token_files.write_token_files(docs, WORD, partitions=2)
    plan = token_files.metadata(files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan
    some = token_files.ids_between(files, 20, 29)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,20), LessThanOrEqual(doc_id,29)" in plan
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in pairs(docs) if i is not None and 20 <= i <= 29}
    assert dict(map(tuple, token_files.metadata(files).collect())) == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in pairs(docs)}


def test_parts_follow_the_size_of_the_files(docs):
    assert parts_for(docs) == 4 and parts_for(docs, part_bytes=10_000) > 4


def test_empty_tables(empty):
    assert token_counts.token_counts(empty, BYTE).count() == 0
    assert sentencepiece_bpe.digests(empty, PIECE).count() == 0
    assert packing.pack(empty, BYTE).count() == 0
    assert token_files.read_digests(token_files.write_token_files(empty, WORD)).count() == 0
