"""Token files: exact round trip, random access, damage, edge rows."""
import io
import struct
import zlib

import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import queries, tokenfile
from panelcast.session import fresh_path

from conftest import SF_SMALL
from llm.helpers import docs, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, offset):
        self.seek(offset)
        return self.read(n)


class Kept(io.BytesIO):
    def close(self):
        self.content = self.getvalue()


def written(documents):
    sink = Kept()
    writer = tokenfile.Writer(sink)
    for doc_id, ids in documents:
        writer.add(doc_id, ids)
    assert writer.close() == len(sink.content)
    return sink.content


def packed(n, first=0):
    return struct.pack(f"<{n}I", *range(first, first + n))


def test_reader_opens_only_the_frames_asked_for(monkeypatch):
    monkeypatch.setattr(tokenfile, "FRAME_BYTES", 400)
    monkeypatch.setattr(tokenfile, "LONG_BYTES", 1000)
    documents = [(i if i else None, packed(n, i)) for i, n in enumerate([3, 90, 0, 120, 900, 1, 1, 40])]
    content = written(documents)
    reader = tokenfile.Reader(Source(content))
    assert reader.ids == [d[0] for d in documents]
    assert reader.document(5) == documents[5][1] and reader.opened == 1
    assert reader.document(6) == documents[6][1] and reader.opened == 1
    assert [reader.document(i) for i in range(8)] == [d[1] for d in documents]
    # any reader of the format gives the ids of all
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert whole == b"".join(d[1] for d in documents)


def test_damage_is_found():
    content = bytearray(written([(i, packed(100_000, i)) for i in range(4)]))
    content[100] ^= 1
    reader = tokenfile.Reader(Source(bytes(content)))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.document(0)
    assert reader.document(3) == packed(100_000, 3)
    with pytest.raises(ValueError):
        tokenfile.Reader(Source(bytes(content[:-1])))


def expected(rows, end_id):
    tokenizer = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_round_trip_of_edge_rows(spark):
    rows = [(9, prose(1, 500)), (3, None), (4, ""), (-2, "Größe 12 <|endoftext|> 你好"), (7, "same"), (7, "same"), (None, "no name"), (8, prose(2, 60_000))]
    folder = fresh_path(spark, "token-test")
    table = docs(spark, rows).withColumns({"id": F.lit("clash"), "tie": F.lit(1), "row": F.lit(2), "part": F.lit(3)})
    manifest = tokenfile.write_tokens(table, PATH, folder, end_id=1)
    assert manifest.agg(F.sum("documents")).first()[0] == len(rows)
    got = tokenfile.read_tokens(spark, folder)
    assert sorted(map(tuple, got.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=lambda r: r[1]) == expected(rows, 1)
    some = tokenfile.read_tokens(spark, folder, ids=[7, -2, 1000])
    whole = {(r.doc_id, r.start): r.ids for r in got.collect()}
    assert sorted((r.doc_id, r.start) for r in some.collect()) == sorted(k for k in whole if k[0] in (7, -2))
    assert all(r.ids == whole[r.doc_id, r.start] for r in some.collect())


def test_empty(spark):
    folder = fresh_path(spark, "token-test")
    tokenfile.write_tokens(docs(spark, []), PATH, folder)
    assert tokenfile.read_tokens(spark, folder).collect() == []


def test_files_roll_over(spark, monkeypatch):
    rows = [(i, prose(i, 30)) for i in range(40)]
    monkeypatch.setattr(tokenfile, "FILE_DOCUMENTS", 3)
    folder = fresh_path(spark, "token-test")
    manifest = tokenfile.write_tokens(docs(spark, rows).coalesce(1), PATH, folder)
    assert manifest.count() > 10
    got = tokenfile.read_tokens(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected(rows, 1)


def test_query_on_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_token_files(spark, SF_SMALL).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got) == expected(rows, 1)
