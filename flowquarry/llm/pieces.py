"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Text is cut where no vocabulary piece can reach across: before a run of blanks and around line feeds.
Each distinct chunk is encoded by a score-ordered agenda of adjacent symbol pairs: of all adjacent pairs
that form a piece, the one with the best score, leftmost among equals, is joined until none is left.
The agendas of all new chunks of a batch run side by side as numpy arrays, one join of each chunk a round;
a chunk of more than ``SIDE_BY_SIDE`` symbols has a heap of its own, as a round costs its whole length.
Each Arrow batch checks its new chunks against the sentencepiece library, and a difference is an error:
the ids that come out are the agenda's.  Decoding is the library's.  A Python worker keeps the chunks
that it met last over its tasks, in two generations of ``MEMORY`` chunks.

Defined cases: null text is empty and has no ids; long texts are encoded whole, their chunks one by
one; repeated rows and other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowquarry.llm.common import slices

SIDE_BY_SIDE = 512
#: Chunks of a generation that a Python worker remembers.
MEMORY = 300_000
BLANK = "▁"
LETTER = "a-zA-ZÀ-ÖØ-öø-ɏ"


class PieceModel:
    """Merge table of a BPE model file: pairs of symbols and the piece that they form."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, proto.pieces
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with identity normalisation, dummy prefix and byte fallback")
        if any(re.search(f"[^{BLANK}]{BLANK}|\n|[{LETTER}][.,]", p.piece) for p in kinds if p.type == 1):
            raise ValueError("a piece reaches across a place where texts are cut")
        ids = {p.piece: i for i, p in enumerate(kinds) if p.type == 1}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(kinds) if p.type == 6}
        symbols = {c for piece in ids for c in piece}
        #: Single characters that are pieces have their id; other characters of longer pieces get numbers after all ids.
        self.chars = {c: ids[c] if c in ids else len(kinds) + i for i, c in enumerate(sorted(symbols))}
        self.text = {i: c for c, i in self.chars.items()}
        self.symbol = -1 - np.arange(0x110000)
        self.symbol[[ord(c) for c in self.chars]] = list(self.chars.values())
        number = {**self.chars, **ids}
        pairs = [(number[p[:k]], number[p[k:]], i) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, made = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.made = keys[order], made[order]
        score = np.array([p.score for p in kinds], dtype=np.float64)
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.n_ids = len(kinds)
        self.lead = self.library.encode("\n")
        self.table: dict[int, int] = {}

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair forms; a rank past all others where it forms none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        made = np.where(hit, self.made[at], 0)
        return np.where(hit, self.rank[made], self.n_ids), made

    def agenda(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks, in which blanks are written as in the vocabulary, as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        if (long := np.flatnonzero(sizes > SIDE_BY_SIDE)).size:
            some = set(long.tolist())
            short = iter(self.agenda([c for i, c in enumerate(chunks) if i not in some]))
            return [self.agenda_of_one(c) if i in some else next(short) for i, c in enumerate(chunks)]
        if not chunks:
            return []
        own, size = np.arange(len(chunks)), sizes
        sym = self._symbols("".join(chunks))
        starts = np.cumsum(size) - size
        rank, made = np.full(len(sym), self.n_ids, dtype=np.int64), np.zeros(len(sym), dtype=np.int64)
        rank[:-1], made[:-1] = self._rank_of(sym[:-1], sym[1:])
        rank[starts + size - 1] = self.n_ids
        ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunks, their sizes and symbols
        while len(own):
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts)
            live = best >> 32 < self.n_ids
            stay = np.repeat(live, size)
            if not live.all():
                ended.append((own[~live], size[~live], sym[~stay]))
                before = np.cumsum(~stay)
                best = (best & 0xFFFFFFFF)[live]
                best = best - before[best]
                own, size, sym, rank, made = own[live], size[live], sym[stay], rank[stay], made[stay]
                if not len(own):
                    break
            else:
                best = best & 0xFFFFFFFF
            # The best pair of each chunk becomes one symbol; its right symbol leaves.
            sym[best] = made[best]
            keep = np.ones(len(sym), dtype=bool)
            keep[best + 1] = False
            sym, rank, made = sym[keep], rank[keep], made[keep]
            size = size - 1
            starts = np.cumsum(size) - size
            best = best - np.arange(len(best))
            rank[best] = self.n_ids
            left = np.concatenate([best[best < starts + size - 1], best[best > starts] - 1])
            rank[left], made[left] = self._rank_of(sym[left], sym[left + 1])
        which, size, flat = (np.concatenate(x) for x in zip(*ended, strict=True))
        odd = (flat < 0) | (flat >= self.n_ids)
        raw, stops = flat.astype("<i4").tobytes(), np.cumsum(size)
        out = [b""] * len(chunks)
        for i, a, b in zip(which.tolist(), ((stops - size) * 4).tolist(), (stops * 4).tolist(), strict=True):
            out[i] = raw[a:b]
        for j in np.unique(np.searchsorted(stops, np.flatnonzero(odd), side="right")).tolist():
            out[which[j]] = self._ids(flat[stops[j] - size[j] : stops[j]].tolist())
        return out

    def agenda_of_one(self, chunk: str) -> bytes:
        """Ids of one chunk, its agenda as a heap over a chain of symbols."""
        sym = self._symbols(chunk).tolist()
        if not self.table:
            self.table = dict(zip(self.keys.tolist(), self.made.tolist(), strict=True))
        before, after = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]

        def entry(i: int) -> tuple[int, int, int, int, int] | None:
            j = after[i] if i >= 0 else -1
            made = self.table.get(sym[i] << 32 | sym[j]) if j >= 0 and sym[i] >= 0 and sym[j] >= 0 else None
            return None if made is None else (int(self.rank[made]), i, made, sym[i], sym[j])

        heap = [e for i in range(len(sym)) if (e := entry(i))]
        heapq.heapify(heap)
        gone = bytearray(len(sym))
        while heap:
            _, i, made, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue  # one of the two has been joined since
            sym[i], gone[j], after[i] = made, 1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if e := entry(k):
                    heapq.heappush(heap, e)
        return self._ids([s for s, x in zip(sym, gone, strict=True) if not x])

    def _symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]

    def _ids(self, symbols: list[int]) -> bytes:
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.n_ids:
                out.append(s)
            else:  # a character outside the vocabulary: its bytes
                out.extend(self.bytes[b] for b in (chr(-1 - s) if s < 0 else self.text[s]).encode("utf-8"))
        return np.array(out, dtype="<i4").tobytes()

    def checked(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks by the agenda; an error if the library has others."""
        out = self.agenda(chunks)
        # A line feed, which no piece reaches across, keeps the chunks of a call apart.
        feed = np.array([self.bytes[10]], dtype="<i4").tobytes()
        for at in range(0, len(chunks), 64):
            part = chunks[at : at + 64]
            got = self.library.encode("\n" + "\n".join(part).replace(BLANK, " "))[len(self.lead) - 1 :]
            if np.array(got, dtype="<i4").tobytes() != feed + feed.join(out[at : at + 64]):
                wrong = [c for c, x in zip(part, out[at:], strict=False) if np.frombuffer(x, dtype="<i4").tolist() != self.library_chunk(c)]
                raise ValueError(f"agenda and library differ on {wrong!r}")
        return out

    def library_chunk(self, chunk: str) -> list[int]:
        return self.library.encode("\n" + chunk.replace(BLANK, " "))[len(self.lead) :]


class PieceEncoder:
    """Encodes texts with a bounded memory of chunks."""

    #: Also before a full stop or comma after a letter, which fewer distinct chunks come from.
    CHUNKS = re.compile(f"{BLANK}*+[^{BLANK}\n.,]++(?<=[{LETTER}])(?=[.,])|{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        self.names = [b"%d" % i for i in range(self.model.n_ids)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids, as little-endian 32-bit integers, and the same as decimals between commas."""
        cut = [self.CHUNKS.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        wanted = set(chain.from_iterable(cut))
        new = wanted.difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.older, self.known, new = self.known, {}, wanted
        older, known = self.older, self.known
        kept = [c for c in new if c in older]
        known.update((c, older[c]) for c in kept)
        new = list(new.difference(kept))
        ids = self.model.checked(new)
        shown = list(map(self.names.__getitem__, np.frombuffer(b"".join(ids), dtype="<i4").tolist()))
        at = 0
        for c, x in zip(new, ids, strict=True):
            known[c] = x, b",".join(shown[at : (at := at + len(x) // 4)])
        get, out = known.__getitem__, []
        for x in cut:
            parts = list(map(get, x))
            out.append((b"".join([p[0] for p in parts]), b",".join([p[1] for p in parts])))
        return out


#: Encoders of this Python worker, by path of the model.
_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.  ``model``: place of a .model file on every node."""
    return encoded(docs, model).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encoded(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """Digests of ids and of decoded text for every row; with the ids and the decoded text themselves if asked."""
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model)
        for whole in batches:
            for b in slices(whole, 1, 4_000_000):
                got = coder.encode([t.as_py() or "" for t in b.column(1)])
                ids = [np.frombuffer(x, dtype="<i4").tolist() for x, _ in got]
                texts = coder.model.library.decode(ids, num_threads=1) if ids else []
                sha = [hashlib.sha256(x).hexdigest() for _, x in got]
                out = [b.column(0), pa.array(map(len, ids), pa.int64()), pa.array(sha), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts], pa.string())]
                if with_ids:
                    out += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))
