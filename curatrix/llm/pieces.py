"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

A normalised text falls into chunks, runs of blanks with the characters after them, that no piece
of the vocabulary spans.  Within a chunk the encoder walks left to right: an Aho-Corasick
automaton gives the pieces that start at each place, the longest is tried first, and it is kept
if it stays apart from the piece before it when the two are merged anew.  Where no piece fits, the
place is marked in a bitfield as failed and the walk steps back.  A sequence whose neighbours all
fit is the one that merging gives, so each place is entered once.  Runs of two or more blanks can
tie in score; their chunks are merged directly.

Cases: null counts as the empty text, which has only the begin and end ids; characters without a
piece become byte pieces; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
from array import array
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
MODEL = "piece_bpe_32k.model"
#: Chunks whose ids a worker remembers; as many again are kept from before.
REMEMBERED = 300_000


class Encoder(dict):
    """A chunk's ids as little-endian unsigned 32-bit integers, remembered."""

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        super().__init__()
        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.piece = {i: sp.id_to_piece(i) for i in plain}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: sp.get_score(i) for p, i in self.id.items()}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        bytes_ = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte = [bytes_.get(f"<0x{b:02X}>", self.unk) for b in range(256)]
        self.longest = max(map(len, self.id))
        if any(BLANK in p.lstrip(BLANK) for p in self.id):
            raise ValueError("a piece spans a blank, so chunks aren't apart")
        self.trie = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.trie.add_word(p, (len(p), i))
        self.trie.make_automaton()
        self.fits: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.older: dict[str, bytes] = {}
        spans = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        # what no piece holds beside another character, and marks that no piece holds behind a letter, end a chunk
        alone = "" if any("\n" in s for s in spans) else "\n"
        marks = "".join(re.escape(c) for c in string.punctuation if not any(s[1] == c and re.match(r"[^\W\d_]", s[0]) for s in spans))
        self.chunks = re.compile((f"{BLANK}*[^\\W\\d_]++(?=[{marks}])|" if marks else "") + f"{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+" + (f"|{alone}" if alone else "")).findall
        known = "".join(re.escape(p) for p in self.id if len(p) == 1)
        self.runs = re.compile(f"[{known}]+|[^{known}]").findall

    def merged(self, text: str) -> list[int]:
        """The ids by merging the best pair again and again, the leftmost of equals first."""
        sym = list(text)
        left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (s := self.score.get(sym[a] + sym[b])) is not None:
                heapq.heappush(heap, (-s, a, b, len(sym[a]) + len(sym[b])))

        for k in range(len(sym) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not sym[a] or not sym[b] or len(sym[a]) + len(sym[b]) != size:
                continue
            sym[a] += sym[b]
            sym[b] = ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        out: list[int] = []
        for s in sym:
            if s:
                out += [self.id[s]] if s in self.id else [self.byte[b] for b in s.encode()]
        return out

    def fit(self, key: int) -> bool:
        """Whether the pieces key >> 20 and key & 0xFFFFF stay apart when their text is merged anew."""
        if len(self.fits) >= 4 * REMEMBERED:
            self.fits.clear()
        a, b = key >> 20, key & 0xFFFFF
        known = self.fits[key] = self.merged(self.piece[a] + self.piece[b]) == [a, b]
        return known

    def stands(self, a: int) -> bool:
        known = self.whole.get(a)
        if known is None:
            known = self.whole[a] = self.merged(self.piece[a]) == [a]
        return known

    def backtracked(self, text: str) -> list[int] | None:
        """The ids of a text; None if it has a character without a piece."""
        n = len(text)
        starts: list = [None] * n
        for end, found in self.trie.iter(text):
            at = end + 1 - found[0]
            if starts[at] is None:
                starts[at] = [found]
            else:
                starts[at].append(found)
        if None in starts:
            return None
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        tried: list[int] = []
        fits, at, before = self.fits, 0, -1
        options = starts[0]
        k = len(options) - 1
        while True:
            while k >= 0:
                size, piece = options[k]
                to = at + size
                if not failed[to >> 3] & (1 << (to & 7)):
                    if before < 0:
                        if self.stands(piece):
                            break
                    else:
                        key = before << 20 | piece
                        ok = fits.get(key)
                        if self.fit(key) if ok is None else ok:
                            break
                k -= 1
            if k >= 0:
                out.append(piece)
                if to == n:
                    return out
                tried.append(k)
                at, before, options = to, piece, starts[to]
                k = len(options) - 1
            elif out:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(self.piece[out.pop()])
                before = out[-1] if out else -1
                options = starts[at]
                k = tried.pop() - 1
            else:
                raise ValueError("merging gives a piece that the vocabulary doesn't hold")

    def ids(self, chunk: str) -> list[int]:
        if chunk.startswith(BLANK * 2):
            return self.merged(chunk)
        if (out := self.backtracked(chunk)) is not None:
            return out
        out = []
        for run in self.runs(chunk):
            out += self.backtracked(run) or [self.byte[b] for b in run.encode()]
        return out

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.pop(chunk, None)
        if ids is None:
            ids = array("I", self.ids(chunk)).tobytes()
        if len(chunk) <= 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """All ids of a text, with begin and end, as little-endian unsigned 32-bit integers."""
        body = b"".join(map(self.__getitem__, self.chunks(BLANK + text.replace(" ", BLANK)))) if text else b""
        return array("I", [self.bos]).tobytes() + body + array("I", [self.eos]).tobytes()

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(array("I", ids).tolist())


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def round_trip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; with ``keep`` also ids (binary) and decoded.

    Rows are encoded where they are read, batch by batch; nothing is shuffled.
    """
    model = model or model_path()

    def run(batches):
        import pyarrow as pa

        enc = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for t in part.column(1).to_pylist():
                    ids = enc.encode(t)
                    decoded = enc.decode(ids)
                    row = (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, ids, decoded) if keep else row)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()][: 5 if keep else 3]
                cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(cols) + 1])

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    return chosen.mapInArrow(run, schema)
