"""BPE encoding and decoding by content-defined chunk reuse.

1. A gear rolling hash over the UTF-8 bytes cuts every text into chunks whose borders depend on
   content only, so passages shared by documents give the same chunks wherever they stand.
2. A chunk seen before in the task is not encoded again: its ids, decimal form and decoded form
   come from a bounded memo. The part of a chunk that is encoded is its body, the span between its first
   and last ASCII white space; a chunk without white space has no body.
3. Joins are repaired: the cut-through text between two bodies is encoded anew, together with a growing
   flank of whole words on both sides, until the encoding of the window equals the separate encodings put
   together; if no window of the document agrees, the whole document is encoded directly.

Inside a body, runs between ASCII white space are memoised too, as this family of pre-tokenizers never
merges across white space; every join window re-checks that assumption with the library itself.

The memo lives in a task, so the plan is narrow: no shuffle, no state to lose with an executor.

Null text counts as empty: no ids, and decoded text "". Texts are never cut; extra columns are kept out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.textvec import SLICE_BYTES, slices

_GEAR = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64)
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string, n_chunks int, n_reused int, n_repairs int"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks int, n_reused int, n_repairs int"


def cut_points(data: np.ndarray, offsets: np.ndarray, mask_bits: int = 11, shortest: int = 512, longest: int = 16384) -> list[np.ndarray]:
    """Chunk ends of every text: where the rolling hash of the last 32 bytes has ``mask_bits`` zero bits,
    not sooner than ``shortest`` bytes and not later than ``longest``; never inside a character."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):  # h[i] = sum of GEAR[data[i-k]] << k over 32 bytes, by doubling
        if len(h) > shift:
            h[shift:] = h[shift:] + (h[:-shift] << np.uint64(shift))
    hits = np.flatnonzero((h >> np.uint64(20)) & np.uint64((1 << mask_bits) - 1) == 0) + 1
    out = []
    for first, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        own = hits[np.searchsorted(hits, first + shortest) : np.searchsorted(hits, end)].tolist()
        ends, last = [], first
        for p in [*own, end]:
            while p - last > longest:
                q = last + longest
                while q > last and data[q] & 0xC0 == 0x80:
                    q -= 1
                ends.append(q)
                last = q
            if p == end or p - last >= shortest:
                while p < end and data[p] & 0xC0 == 0x80:
                    p += 1
                if p > last:
                    ends.append(p)
                    last = p
        out.append(np.array(ends, np.int64))
    return out


class ChunkCoder:
    """Encoder of one task. ``pieces``: white-space-free run -> (count, ids in decimal, tokens joined)."""

    def __init__(self, vocabulary: str, memo_pieces: int = 400_000, memo_chunk_bytes: int = 48 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(vocabulary)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.by_id = {i: w for w, i in self.tok.get_vocab(with_added_tokens=True).items()}
        self.memo_pieces, self.memo_chunk_bytes = memo_pieces, memo_chunk_bytes
        self.pieces: dict[bytes, tuple[int, str, str]] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = 0

    def code(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join(map(str, ids)), " ".join(map(self.by_id.__getitem__, ids))

    def whole(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(count, decimal ids, decoded text) of texts, by the library alone."""
        ids = [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)]
        return [(len(i), " ".join(map(str, i)), self.tok.decode(i, skip_special_tokens=False)) for i in ids]

    def learn(self, words: list[bytes]) -> None:
        """Encode the runs that the memo lacks: plain ones many at a time, split by their offsets."""
        pieces, plain, odd, marked = self.pieces, {}, {}, []
        for w in words:
            if w in pieces:
                continue
            base = w.rstrip(b".,;:!?")
            if base != w and base[-1:].isalpha():  # ASCII: the pre-tokenizer always splits here
                marked.append((w, base, w[len(base) :]))
                if base in pieces:
                    continue
                w = base
            text = w.decode()
            (plain if text.isalpha() and (w.isascii() or is_normalized("NFC", text)) else odd)[w] = text
        odd.update((mark, mark.decode()) for _, _, mark in marked if mark not in pieces)
        for w, e in zip(odd, self.tok.encode_batch(list(odd.values()), add_special_tokens=False) if odd else []):
            pieces[w] = self.code(e.ids)
        runs, texts = list(plain), list(plain.values())
        groups = [slice(i, i + 512) for i in range(0, len(runs), 512)]
        for own, e in zip(groups, self.tok.encode_batch([" ".join(texts[g]) for g in groups], add_special_tokens=False) if groups else []):
            group, ends = runs[own], np.cumsum([len(w) + 1 for w in texts[own]])
            ids = e.ids
            cuts = np.searchsorted(np.fromiter((x[0] for x in e.offsets), np.int64, len(ids)), ends).tolist()
            first = 0
            for w, cut in zip(group, cuts):
                pieces[w] = self.code(ids[first:cut])
                first = cut
        for w, base, mark in marked:
            (n, x, y), (m, u, v) = pieces[base], pieces[mark]
            pieces[w] = (n + m, f"{x} {u}", f"{y} {v}")

    def spell(self, words: list[bytes]) -> tuple[int, str, str]:
        pieces = self.pieces
        try:
            got = [pieces[w] for w in words]
        except KeyError:
            self.learn(words)
            got = [pieces[w] for w in words]
        n = [g[0] for g in got]
        if 0 in n:  # a run that normalises to nothing
            got = [g for g in got if g[0]]
        return sum(n), " ".join([g[1] for g in got]), " ".join([g[2] for g in got])

    def chunk(self, piece: bytes) -> tuple[tuple, bool]:
        """((head, body words at both ends, body code, tail), reused); no body: (whole, None, None, b"")."""
        found = self.chunks.get(piece)
        if found is not None:
            return found, True
        words = piece.split()
        head = b"" if piece[:1].isspace() else words[0] if words else b""
        tail = b"" if piece[-1:].isspace() else words[-1] if words else b""
        if head and tail and len(words) == 1:
            made = (piece, None, None, b"")
        else:
            body = words[bool(head) : len(words) - bool(tail)]
            made = (head, (body[:4], body[-4:]), self.spell(body), tail)
        if self.chunk_bytes > self.memo_chunk_bytes:
            self.chunks.clear()
            self.chunk_bytes = 0
        self.chunks[piece] = made
        self.chunk_bytes += len(piece) + (len(made[2][1]) + len(made[2][2]) if made[2] else 0)
        return made, False

    def slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, str, int, int, int]]:
        """(count, decimal ids, decoded, chunks, reused, repairs) of every text."""
        if len(self.pieces) > self.memo_pieces:
            self.pieces.clear()
        raw = data.tobytes()
        docs, windows = [], []  # a window: [document, words before, repaired span, words after, flank]
        cuts, last = [], 0
        new: dict[bytes, list[bytes]] = {}
        for ends in cut_points(data, offsets):
            own = []
            for end in ends.tolist():
                own.append(raw[last:end])
                last = end
            cuts.append(own)
            new.update((c, c.split()) for c in own if c not in self.chunks and c not in new)
        self.learn([w for words in new.values() for w in words])
        joined = []
        for d, own in enumerate(cuts):
            parts, reused, joins, carry = [], 0, 0, b""
            before: list[bytes] = []
            for piece in own:
                (head, edge, code, tail), again = self.chunk(piece)
                reused += again
                if code is None:
                    carry += head
                    continue
                span = carry + head
                if span:
                    joins += 1
                    windows.append([d, before, span, edge[0], 1])
                    parts.append(span)
                parts.append(code)
                before, carry = edge[1], tail
            if carry:
                joins += 1
                windows.append([d, before, carry, [], 1])
                parts.append(carry)
            joined.append((parts, len(own), reused, joins))
        self.learn([w[2] for w in windows])
        for parts, *counts in joined:
            codes = [self.spell([p]) if isinstance(p, bytes) else p for p in parts]
            codes = [c for c in codes if c[0]]
            docs.append([sum(c[0] for c in codes), " ".join([c[1] for c in codes]), " ".join([c[2] for c in codes]), *counts])
        windows = [w for w in windows if w[1] or w[3]]  # others are whole documents
        direct = set()
        while windows:  # repair: widen each window until the library's encoding agrees with the parts
            todo = []
            got = self.whole([b" ".join([*w[1][-w[4] :], w[2], *w[3][: w[4]]]).decode() for w in windows])
            for w, (_, digits, _) in zip(windows, got):
                words = [*w[1][-w[4] :], w[2], *w[3][: w[4]]]
                if digits != self.spell(words)[1]:
                    if w[4] >= max(len(w[1]), len(w[3])):
                        direct.add(w[0])
                    else:
                        todo.append([*w[:4], w[4] + 1])
            windows = todo
        for d in direct:
            docs[d][:3] = self.whole([raw[offsets[d] : offsets[d + 1]].decode()])[0]
        yield from map(tuple, docs)


def _encode_batches(vocabulary: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = ChunkCoder(vocabulary)
        for batch in batches:
            ids_of = batch.column(0)
            for first, end, data, offsets in slices(batch.column(1), SLICE_BYTES):
                rows = list(coder.slice(data, offsets))
                tail = [pa.array([r[i] for r in rows], pa.int32()) for i in (3, 4, 5)]
                n = pa.array([r[0] for r in rows], pa.int64())
                if digest:
                    a = pa.array([hashlib.sha256(r[1].encode()).hexdigest() for r in rows], pa.string())
                    b = pa.array([hashlib.sha256(r[2].encode()).hexdigest() for r in rows], pa.string())
                else:
                    a = pa.array([[int(x) for x in r[1].split()] for r in rows], pa.list_(pa.int32()))
                    b = pa.array([r[2] for r in rows], pa.string())
                names = ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digest else ("ids", "decoded")), "n_chunks", "n_reused", "n_repairs"]
                yield pa.RecordBatch.from_arrays([ids_of[first:end], n, a, b, *tail], names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str, digest: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text; with ``digest``, their SHA-256 instead.

    Empty tables give no rows; repeated rows give a row each; a null text is as an empty one.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_encode_batches(vocabulary, digest), DIGEST_SCHEMA if digest else SCHEMA)
