"""Token ids in a content-addressed store.

Documents are encoded with the tokenizers library and an end id.  A rolling hash over the ids cuts
each stream where its low bits are zero, so equal passages give equal chunks wherever they stand.
A chunk's address is a digest of its ids; every different chunk is stored once, by the first
document that holds it.

Files, all Parquet, under one folder:

* ``segments``: one file a segment, documents in ascending order of doc_id across segments.  A row
  has the document's leaf (digest of its chunks' addresses and length), its place in the segment,
  its number of ids, and, for the first document of a leaf, its recipe (addresses and lengths) with a pack:
  the chunks that it owns, as little-endian unsigned integers of 16 or 32 bits, compressed.
* The last row of a segment is its manifest: number of documents and of ids, and the Merkle root of its leaves.

Reading gives every document's ids back: packs and chunks owned by others are put together by
recipe, and each chunk's address, each leaf and each segment's root are computed anew and compared.

Cases: null counts as the empty text, which has the end id alone; rows repeated with one doc_id
are documents of their own, in the order of their leaves; equal documents (ties) share a leaf; rows without doc_id come first; texts of any
length are encoded whole, as many chunks; an empty table gives no rows; of the
table only the named columns are read, so columns of the names used here don't matter.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
import zlib
from array import array
from codecs import charmap_decode
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MODEL = "byte_bpe_50k.json"
END = 0
#: A chunk ends where the hash of the last ``SEEN`` ids is 0 modulo ``MEAN``, but not before LEAST ids and at MOST ids at the latest.
SEEN, MEAN, LEAST, MOST = 8, 512, 128, 4096
#: Pretokens whose ids a worker remembers; as many again are kept from before.
REMEMBERED = 600_000
#: Uses of a chunk for each copy of it that is dealt out on reading.
SPREAD = 256
ADDRESS = 16


def _class(first: str) -> str:
    """A regular expression's ranges of the characters below U+0250 whose category starts so."""
    own = [c for c in range(0x250) if unicodedata.category(chr(c)).startswith(first)]
    out, k = "", 0
    while k < len(own):
        to = k
        while to + 1 < len(own) and own[to + 1] == own[to] + 1:
            to += 1
        out += f"{re.escape(chr(own[k]))}-{re.escape(chr(own[to]))}"
        k = to + 1
    return out


class Encoder(dict):
    """The library's ids of a pretoken, as little-endian unsigned 32-bit integers, remembered.

    Byte-level BPE never merges across pretokens.  Texts of Latin letters and plain blanks are cut
    into pretokens here, others are left to the library as a whole.  So are texts that hold a special token's
    characters: by default the library takes them for the token, with ``special`` false for plain text; and all texts of models that normalise.
    """

    def __init__(self, model: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.encode_special_tokens = not special
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = self.tokenizer.normalizer is not None
        # a pretoken goes to the merges alone, its bytes as the characters that byte-level models have for them
        self.merged = self.tokenizer.model.tokenize
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*own}))}
        self.letters = "".join(others.get(b, chr(b)) for b in range(256))
        self.older: dict[str, bytes] = {}
        letters, digits = _class("L"), _class("N")
        self.cut = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{digits}]+| ?[^\s{letters}{digits}]+|\s+(?!\S)|\s+").findall
        self.unknown = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]").search

    def odd(self, text: str) -> bool:
        return self.whole or bool(self.unknown(text)) or any(s in text for s in self.special)

    def ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, token: str) -> bytes:
        """The ids of a pretoken from before or else the library's, from now on remembered."""
        found = self.older.get(token)
        if found is None:
            found = array("I", [t.id for t in self.merged(charmap_decode(token.encode(), "strict", self.letters)[0])]).tobytes()
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[token] = found
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of some texts."""
        look = self.__getitem__
        return [b"" if not t else self.ids(t) if self.odd(t) else b"".join(map(look, self.cut(t))) for t in texts]


@lru_cache(maxsize=2)
def encoder(model: str, special: bool = True) -> Encoder:
    return Encoder(model, special)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=1)
def _gear():
    """A 64-bit number for every id below 2 ** 20, by splitmix64."""
    import numpy as np

    x = np.arange(1, 2**20 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(ids) -> list[int]:
    """Ends of the chunks of an array of ids."""
    import numpy as np

    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g = _gear()[ids & np.uint32(2**20 - 1)]
    h = g.copy()
    for k in range(1, SEEN):
        h[k:] += g[:-k] << np.uint64(k)
    likely = np.flatnonzero((h >> np.uint64(24)) % np.uint64(MEAN) == 0) + 1
    out, at = [], 0
    for c in [*likely.tolist(), n]:
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST or c == n and c > at:
            out.append(c)
            at = c
    return out


def _narrow(ids: bytes) -> bytes:
    """Ids as a pack holds them: 16 bits each behind the byte 2 where all fit, else 32 bits each behind the byte 4."""
    import numpy as np

    x = np.frombuffer(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if not len(x) or x.max() < 2**16 else b"\4" + ids


def _wide(pack: bytes) -> bytes:
    import numpy as np

    return np.frombuffer(pack, "<u2", offset=1).astype("<u4").tobytes() if pack[0] == 2 else pack[1:]


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=ADDRESS).digest()


def leaf(addresses: bytes, n: int) -> bytes:
    return hashlib.blake2b(b"\0" + n.to_bytes(8, "little") + addresses, digest_size=ADDRESS).digest()


class Merkle:
    """The root of leaves that come one by one, with one digest a level in memory."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, digest: bytes) -> None:
        for k, held in enumerate(self.levels):
            if held is None:
                self.levels[k] = digest
                return
            digest = hashlib.sha256(b"\1" + held + digest).digest()
            self.levels[k] = None
        self.levels.append(digest)

    def root(self) -> bytes:
        out = b""
        for held in self.levels:
            if held is not None:
                out = hashlib.sha256(b"\1" + held + out).digest() if out else held
        return out


def _encoded(docs: DataFrame, doc_id: str, text: str, model: str, end: int, special: bool) -> DataFrame:
    """doc_id, leaf, n, addresses, lens and ids of each document, where it is read."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        enc, pack = encoder(model, special), zstandard.ZstdCompressor(level=3)
        tail = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for raw in enc.encode(part.column(1).to_pylist()):
                    raw += tail
                    ends = cuts(np.frombuffer(raw, "<u4"))
                    starts = [0, *ends[:-1]]
                    addresses = b"".join(address(raw[4 * a : 4 * b]) for a, b in zip(starts, ends))
                    n = len(raw) // 4
                    rows.append((leaf(addresses, n), n, addresses, [b - a for a, b in zip(starts, ends)], pack.compress(_narrow(raw))))
                kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.binary())
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "leaf", "n", "addresses", "lens", "ids"])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, leaf binary, n long, addresses binary, lens array<int>, ids binary")


def _shared(encoded: DataFrame) -> DataFrame:
    """What the first documents of their leaves must know: (doc_id, leaf, first, uses).

    ``first`` is false for documents whose leaf an earlier one has; ``uses`` has, for the places of
    chunks that occur more than once, (place, number of uses, whether this place owns it).
    """
    keys = encoded.select("doc_id", "leaf").distinct()
    firsts = keys.groupBy("leaf").agg(F.min("doc_id").alias("owner"), F.count("*").alias("docs"))
    later = keys.join(firsts.where("docs > 1"), "leaf").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    held = encoded.groupBy("leaf").agg(F.min("doc_id").alias("doc_id"), F.max("addresses").alias("addresses"))
    places = held.select("doc_id", "leaf", F.explode(F.sequence(F.lit(0), (F.length("addresses") / ADDRESS).cast("int") - 1)).alias("place"), "addresses")
    places = places.select("doc_id", "leaf", "place", F.substring(F.col("addresses"), F.col("place") * ADDRESS + 1, F.lit(ADDRESS)).alias("address"))
    places = C.materialize(places, "store-places")
    often = places.groupBy("address").agg(F.count("*").alias("uses"), F.min(F.struct("doc_id", "leaf", "place")).alias("owner")).where("uses > 1")
    uses = places.join(often, "address").groupBy("doc_id", "leaf").agg(
        F.collect_list(F.struct("place", "uses", (F.col("doc_id").eqNullSafe(F.col("owner.doc_id")) & (F.col("leaf") == F.col("owner.leaf")) & (F.col("place") == F.col("owner.place"))).alias("own"))).alias("uses")
    )
    kind = "array<struct<place:int,uses:bigint,own:boolean>>"
    return uses.select("doc_id", "leaf", F.lit(True).alias("first"), F.col("uses").cast(kind).alias("uses")).union(later.select("doc_id", "leaf", F.lit(False).alias("first"), F.lit(None).cast(kind).alias("uses")))


SEGMENT = "leaf binary, segment int, place long, n long, addresses binary, lens array<int>, uses array<int>, own array<boolean>, pack binary, docs long, root binary"


def write(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", model: str | None = None, end: int = END, segments: int | None = None, special: bool = True) -> None:
    """Writes the store of docs to ``path``.  With ``special`` the characters of a special token in a text are that token, as the library has it."""
    model = model or model_path()
    encoded = C.materialize(_encoded(docs, doc_id, text, model, end, special), "store-encoded", compression="none")
    kind = encoded.schema["doc_id"].dataType.simpleString()
    told = _shared(encoded)
    told = told.select("doc_id", "leaf", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("addresses"), F.lit(None).cast("array<int>").alias("lens"), F.lit(None).cast("binary").alias("ids"), "first", "uses")
    both = told.union(encoded.select("doc_id", "leaf", F.lit(1).alias("kind"), "n", "addresses", "lens", "ids", F.lit(None).cast("boolean").alias("first"), F.lit(None).cast(told.schema["uses"].dataType).alias("uses")))
    dealt = both.repartitionByRange(segments or C.parallelism(docs.sparkSession), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "leaf", "kind")

    def run(batches):
        import numpy as np
        import zstandard
        from pyspark import TaskContext

        segment, place, docs_, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        last = first = uses = id_type = None
        done = False
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 500):
                out = []
                for r in batch.slice(at, 500).to_pylist():
                    key = (r["doc_id"], r["leaf"])
                    if key != last:
                        last, first, uses, done = key, True, {}, False
                    if r["kind"] == 0:
                        first, uses = r["first"], {u["place"]: u for u in r["uses"] or ()}
                        continue
                    row = {"doc_id": r["doc_id"], "leaf": r["leaf"], "segment": segment, "place": place, "n": r["n"]}
                    if first and not done:
                        done = True
                        own = [(u := uses.get(k)) is None or u["own"] for k in range(len(r["lens"]))]
                        held = r["ids"]
                        if not all(own):
                            raw, ends = _wide(unpack.decompress(held)), np.cumsum([0, *r["lens"]]).tolist()
                            held = pack.compress(_narrow(b"".join(raw[4 * a : 4 * b] for o, a, b in zip(own, ends, ends[1:]) if o)))
                        row |= {"addresses": r["addresses"], "lens": r["lens"], "own": own, "pack": held}
                        row["uses"] = [u["uses"] if (u := uses.get(k)) else 1 for k in range(len(own))]
                    tree.add(r["leaf"])
                    place += r["n"]
                    docs_ += 1
                    out.append(row)
                if out:
                    yield _batch(out, id_type)
        if docs_:
            yield _batch([{"segment": segment, "place": place, "n": place, "docs": docs_, "root": tree.root()}], id_type)

    dealt.mapInArrow(run, f"doc_id {kind}, {SEGMENT}").write.option("compression", "none").parquet(f"{path}/segments")
    C.discard(encoded)


def _batch(rows: list[dict], id_type):
    import pyarrow as pa

    kinds = {"doc_id": id_type, "leaf": pa.binary(), "segment": pa.int32(), "place": pa.int64(), "n": pa.int64(), "addresses": pa.binary(), "lens": pa.list_(pa.int32()), "uses": pa.list_(pa.int32()), "own": pa.list_(pa.bool_()), "pack": pa.binary(), "docs": pa.int64(), "root": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in kinds.items()], names=list(kinds))


def verify(spark: SparkSession, path: str) -> dict:
    """Totals of the store: documents, ids and the Merkle root over the segments' roots, computed anew.

    Raises ValueError if a segment's leaves don't give its root.
    """
    stored = spark.read.parquet(f"{path}/segments")

    def roots(batches):
        import pyarrow as pa

        segment, tree = None, Merkle()
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != segment and segment is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([tree.root()], pa.binary())], names=["segment", "root"])
                    tree = Merkle()
                segment = k
                tree.add(x)
        if segment is not None:
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([tree.root()], pa.binary())], names=["segment", "root"])

    # a segment's leaves pass by in order, with one digest a level in memory
    leaves = stored.where("docs is null").select("segment", "place", "leaf").repartition("segment").sortWithinPartitions("segment", "place")
    found = {r["segment"]: bytes(r["root"]) for r in leaves.mapInArrow(roots, "segment int, root binary").collect()}
    top, docs, n = Merkle(), 0, 0
    for r in stored.where("docs is not null").select("segment", "docs", "n", "root").orderBy("segment").collect():
        if found.get(r["segment"]) != bytes(r["root"]):
            raise ValueError(f"segment {r['segment']}: its leaves don't give its root")
        top.add(bytes(r["root"]))
        docs, n = docs + r["docs"], n + r["n"]
    return {"documents": docs, "ids": n, "root": top.root().hex()}


def read(spark: SparkSession, path: str, keep: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files; with ``keep`` also ids.

    A chunk, leaf or length that doesn't agree with its address raises ValueError.
    """
    stored = spark.read.parquet(f"{path}/segments")
    rows = stored.where("docs is null")
    base, at = [], 0
    for r in stored.where("docs is not null").select("segment", "n").orderBy("segment").collect():
        base.append((r["segment"], at))
        at += r["n"]
    bases = spark.createDataFrame(base, "segment int, base long")  # one row a segment
    firsts = rows.where("pack is not null").select("leaf", "n", "addresses", "lens", "uses", "own", "pack")

    def split(batches):
        """Of each recipe the chunks that it has: those to put together (kind 0) and those for others (kind 1), dealt out by uses."""
        import pyarrow as pa
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    raw, b = _wide(unpack.decompress(r["pack"])), 0
                    whole = all(r["own"])
                    for k, (size, own, uses) in enumerate(zip(r["lens"], r["own"], r["uses"])):
                        a, held = r["addresses"][ADDRESS * k : ADDRESS * (k + 1)], None
                        if own:
                            held, b = raw[b : b + 4 * size], b + 4 * size
                            if address(held) != a:
                                raise ValueError("a chunk doesn't agree with its address")
                        salts = -(-uses // SPREAD)
                        if own and uses > 1:
                            out += [(1, a, s, None, None, None, held) for s in range(salts)]
                        if not own:
                            out.append((2, a, int.from_bytes(r["leaf"][:4], "little") % salts, r["leaf"], k, r["n"], None))
                        elif not whole:
                            out.append((0, a, 0, r["leaf"], k, r["n"], held))
                    if whole:
                        if leaf(r["addresses"], len(raw) // 4) != r["leaf"]:
                            raise ValueError("a document doesn't agree with its leaf")
                        out.append((3, None, 0, r["leaf"], zlib.crc32(raw), r["n"], raw if keep else None))
                kinds = (pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names=["kind", "address", "salt", "leaf", "at", "n", "ids"])

    parts = C.materialize(firsts.mapInArrow(split, "kind int, address binary, salt int, leaf binary, at long, n long, ids binary"), "store-parts")
    chunks = parts.where("kind = 1").select("address", "salt", F.col("ids").alias("found"))
    lent = parts.where("kind = 2").drop("ids").join(chunks, ["address", "salt"], "left").select("leaf", "at", "n", "address", F.col("found").alias("ids"))
    mixed = parts.where("kind = 0").select("leaf", "at", "n", "address", "ids").union(lent)
    whole = mixed.groupBy("leaf", "n").agg(F.sort_array(F.collect_list(F.struct("at", "address", "ids"))).alias("parts"))

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for r in batch.slice(at, 200).to_pylist():
                    raw = b"".join(p["ids"] for p in r["parts"])
                    if len(raw) != 4 * r["n"] or leaf(b"".join(p["address"] for p in r["parts"]), r["n"]) != r["leaf"]:
                        raise ValueError("a document doesn't agree with its leaf")
                    out.append((r["leaf"], zlib.crc32(raw), raw if keep else None))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names=["leaf", "ids_crc32", "ids"])

    sums = whole.mapInArrow(join, "leaf binary, ids_crc32 long, ids binary").union(parts.where("kind = 3").select("leaf", F.col("at").alias("ids_crc32"), "ids"))
    located = rows.select("doc_id", "leaf", "segment", "place", "n").join(F.broadcast(bases), "segment")
    out = located.join(sums, "leaf", "left").select("doc_id", (F.col("base") + F.col("place")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32", *["ids"] * keep)
    return out
