"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes through a text once and keeps the positions since the last boundary
that all surviving paths share; it commits the ids before such a boundary. Pieces reach
at most the longest piece's length ahead, so the open window is that long but for texts
whose paths don't meet. Pieces hold a space at their start alone, so all paths meet
before each run of spaces; what lies between such points is searched once and kept in a
bounded memo.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Rows whose ids are Python numbers at a time.
SLICE = 250
#: Segments of up to LONG characters that a process remembers, twice; the search is fed FEED characters at a time, and a text is cut into chunks.
MEMO, LONG, FEED, CHUNK = 200_000, 64, 256, 1 << 16
#: Ends before a run of spaces.
BORDER = re.compile(r"(?s)[^ ](?= )")


def model_file() -> str:
    """The default vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A vocabulary with scores. A space stands for the space mark, so that the mark's own character is text like any other."""

    def __init__(self, pieces: list[tuple[str, float]], byte_ids: list[int], skip: frozenset[int] = frozenset()):
        """byte_ids: the ids of the 256 byte pieces, which stand for characters in no piece; skip: control pieces."""
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces, so not every text can be encoded reversibly")
        self.byte_ids, self.memo, self.older = byte_ids, {}, {}
        self.raw = [p.replace("▁", " ").encode() for p, _ in pieces]
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.scores = [s for _, s in pieces]
        own = {i: p.replace("▁", " ") for i, (p, _) in enumerate(pieces) if i not in skip and i not in set(byte_ids) and p}
        self.trie: dict = {}  # character -> (the same of what may follow, the piece that ends here or -1, its score)
        for i, p in own.items():
            children = self.trie
            for c in p[:-1]:
                children = children.setdefault(c, ({}, -1, 0.0))[0]
            children[p[-1]] = (children.get(p[-1], ({},))[0], i, self.scores[i])
        self.singles = {p for p in own.values() if len(p) == 1}
        self.longest = max(map(len, own.values()), default=1)
        self.unknown = min([self.scores[i] for i in own], default=0.0) - 10
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in own.values()))
        rest = re.escape(" " + alone)
        self.inner = inner = any(" " in p.lstrip(" ") for p in own.values())
        self.segments = re.compile(r"(?s).+" if inner else rf" *[^{rest}]+| +" + (f"|[{re.escape(alone)}]" if alone else ""))

    @classmethod
    def load(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        skip = frozenset(i for i in ids if m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
        return cls([(m.id_to_piece(i), m.get_score(i)) for i in ids], [i for i in ids if m.is_byte(i)], skip)

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the text that the chunks make up, as they are committed. Of equal scores the longer last piece wins.

        Every `stride` positions the ids before the last boundary that all paths share are committed.
        """
        trie, longest, singles, unknown, stride = self.trie, self.longest, self.singles, self.unknown, 4 * self.longest
        feed, text, ended = iter(chunks), "", False  # text: what lies from i on
        score, back, arc = [0.0], [0], [-1]  # by position; an arc below 0 is a character in no piece
        heirs: list[int] = []  # how many searched positions come from each, and the sum of these
        sums: list[int] = []
        root = i = 0  # root: the last boundary before which all ids are committed
        while True:
            while not ended and len(text) < stride + longest:
                more = next(feed, None)
                ended, text = more is None, text + (more or "")
            step = min(stride, len(text) if ended else len(text) - longest)
            if (n := i + min(step + longest, len(text)) + 1 - len(score)) > 0:
                score += [-inf] * n
                back += [0] * n
                arc += [-1] * n
            for k, i in enumerate(range(i, i + step)):
                children, j, here = trie, i, score[i]
                for c in text[k : k + longest]:
                    node = children.get(c)
                    if node is None:
                        break
                    children, piece, s = node
                    j += 1
                    if piece >= 0:
                        s += here
                        if s > score[j]:
                            score[j], back[j], arc[j] = s, i, piece
                if text[k] not in singles and here + unknown > score[i + 1]:
                    score[i + 1], back[i + 1], arc[i + 1] = here + unknown, i, -1 - ord(text[k])
            if ended and step == len(text):
                yield self._path(root, len(score) - 1, back, arc)
                return
            i, text = i + 1, text[step:]
            cut = self._meet(root, i, step, score, back, heirs, sums)
            if cut > root:
                yield self._path(root, cut, back, arc)
                root = cut
            if root > 4096 and 2 * root > i:  # what is committed goes, at a cost below its own length
                back, sums = [max(0, b - root) for b in back[root:]], [s - root * h for s, h in zip(sums[root:], heirs[root:])]
                score, arc, heirs = score[root:], arc[root:], heirs[root:]
                i, root = i - root, 0

    def _meet(self, root: int, i: int, step: int, score: list, back: list, heirs: list, sums: list) -> int:
        """The last boundary, from root on, that the best paths to all open positions (i and later) share.

        The paths are a tree. Searched positions that lead to no open one leave it, each
        once, so that a text costs time linear in its length even where paths never meet.
        """
        last = len(heirs)
        heirs += [0] * (i - last)
        sums += [0] * (i - last)
        for p in range(max(last, root + 1), i):
            heirs[back[p]] += 1
            sums[back[p]] += p
        ends = [j for j in range(i, len(score)) if score[j] > -inf]
        if len(ends) == 1:
            return ends[0]
        held = {back[j] for j in ends}  # an arc is at most `longest` long, so a position that is released lies close
        for p in range(i - 1, max(root, i - step - self.longest - 1), -1):
            while heirs[p] == 0 and p not in held and p > root:
                heirs[p] = -1  # has left
                heirs[back[p]] -= 1
                sums[back[p]] -= p
                p = back[p]
        while heirs[root] == 1 and root not in held:
            root = sums[root]
        return root

    def _path(self, start: int, end: int, back: list, arc: list) -> list[int]:
        out: list[int] = []
        while end > start:
            if arc[end] >= 0:
                out.append(arc[end])
            else:
                out += [self.byte_ids[b] for b in reversed(chr(-1 - arc[end]).encode())]
            end = back[end]
        return out[::-1]

    def _chunks(self, text: str) -> Iterator[str]:
        """Parts of CHUNK characters of the text or more, which end before a run of spaces: no piece crosses that."""
        at = 0
        while at < len(text):
            border = None if self.inner else BORDER.search(text, at + CHUNK - 1)
            end = border.end() if border else len(text)
            yield text[at:end]
            at = end

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for chunk in self._chunks(" " + text):
            for seg in self.segments.findall(chunk):
                ids = memo.get(seg)
                if ids is None:
                    if len(memo) >= MEMO:
                        self.older, self.memo = memo, {}
                        memo = self.memo
                    ids = self.older.get(seg)
                    if ids is None:
                        parts = [*self.stream((seg,) if len(seg) <= LONG else (seg[k : k + FEED] for k in range(0, len(seg), FEED)))]
                        ids = parts[0] if len(parts) == 1 else [*chain.from_iterable(parts)]
                    if len(seg) <= LONG:
                        memo[seg] = ids
                out += ids
        return out

    def decode(self, ids: Iterable[int]) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode(errors="replace")
        return text[1:] if text.startswith(" ") else text


def _ids(of: Pieces, texts: pa.Array) -> pa.ListArray:
    ids = [of.encode(t) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.fromiter(chain.from_iterable(ids), np.int32, ends[-1]))


def _texts(of: Pieces, ids: pa.ListArray) -> list[str]:
    ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return [of.decode(flat[a:z].tolist()) for a, z in zip(ends, ends[1:])]


def encode(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, text_sha256), one row for each row of docs.

    Null and empty text have no ids. Repeated rows and null identifiers stay; an empty
    table gives an empty one; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces or Pieces.load(model_file()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _ids(of, part.column("text")), part.column("text_sha256")], ["doc_id", "ids", "text_sha256"])

    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.sha2(text, 256).alias("text_sha256")).mapInArrow(run, "doc_id long, ids array<int>, text_sha256 string")


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """(doc_id, n_ids, text_sha256, text) from what encode returns; text is decoded from the ids. Null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(pieces or Pieces.load(model_file()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_ids", "text_sha256")), pa.array(_texts(of, part.column("ids")), pa.string())], ["doc_id", "n_ids", "text_sha256", "text"])

    ids = F.coalesce("ids", F.array().cast("array<int>"))
    told = encoded.select("doc_id", ids.alias("ids"), F.size(ids).cast("long").alias("n_ids"), "text_sha256")
    return told.mapInArrow(run, "doc_id long, n_ids long, text_sha256 string, text string")


def round_trip(docs: DataFrame, pieces: Pieces | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, n_ids, ids_sha256, decoded_chars, round_trip): each text's ids, decoded again and compared with the text.

    In one pass, by the functions of encode and decode. ids_sha256 is of the ids as
    little-endian 32-bit numbers. Rows as in encode.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces or Pieces.load(model_file()))
    schema = "doc_id long, ids array<int>, n_ids long, ids_sha256 string, decoded_chars long, round_trip boolean"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids = _ids(of, part.column("text"))
                back = _texts(of, ids)
                ends, raw = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
                digests = [hashlib.sha256(raw[a:z].tobytes()).hexdigest() for a, z in zip(ends, ends[1:])]
                same = [x == y for x, y in zip(back, part.column("text").to_pylist())]
                columns = [pa.array(np.diff(ends), pa.int64()), pa.array(digests, pa.string()), pa.array(map(len, back), pa.int64()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, *columns], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)
