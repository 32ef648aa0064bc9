"""Order-preserving packing by dynamic programming.

Token ids of documents, each ended by an end id, form one stream per input
partition, in the table's own order, so nothing is shuffled.  A window of the
stream holds at most ``length`` tokens.  Windows are cut at document ends (free),
sentence ends (a small penalty) or, inside long sentences, at regular places
(a larger penalty); the cuts minimise padding plus penalties.  As padding is
linear in a window's start, the transition is a minimum over a sliding window
of starts, kept in a monotone queue, so the work is linear in the candidates.

Defined results: a null or empty text is one piece that holds the end id only;
null ids, repeated rows and very long texts are packed like any other; an empty
table gives no piece; only the named columns are read.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import map_arrow

LENGTH = 2048
END_ID = 1
SENTENCE_PENALTY = 2.0
INSIDE_PENALTY = 12.0
#: Tokens between candidate cuts where a sentence has no end.
INSIDE_STEP = 24
#: Tokens that are packed at once; all windows but the last are then settled.
BLOCK_TOKENS = 1 << 19

#: Characters whose case, normal form and class all engines agree on.
_PLAIN = re.compile("[^\\t-\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20ac]")
#: The vocabulary's own split pattern, for those characters.
_LETTER = "a-zA-ZªµºÀ-ÖØ-öø-ɏ"
_NUMBER = "0-9²³¹¼-¾"
_WORDS = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_MARK = "\x01"


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(c): b for b, c in [*zip(shown, shown), *((b, 256 + i) for i, b in enumerate(rest))]}


class WordTokenizer:
    """A word-end BPE vocabulary, run by a rank encoder where that is exact.

    The word end becomes a mark byte; a byte joined to the mark is merged first,
    and every other token ranks as its merge does.  Tokens that their own merges
    do not rebuild get no rank.  Texts with characters beyond ``_PLAIN`` or with a
    special token's string take the vocabulary's library instead, which gives
    such a string its one id; with ``special_as_text`` it is text like any other.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, added = whole["model"], [t["content"] for t in whole.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added and not special_as_text else None
        vocab, letters = model["vocab"], _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        end = _MARK.encode()
        whole = lambda s: raw(s[: -len("</w>")]) + end if s.endswith("</w>") else raw(s)
        ranks = {bytes([b]): b for b in range(256)}
        ids = {bytes([b]): vocab[c] for c, b in letters.items()}
        for c, b in letters.items():
            ranks[bytes([b]) + end] = 256 + b
            ids[bytes([b]) + end] = vocab[c + "</w>"]
        made = {}
        for place, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made.setdefault(whole(a + b), (512 + place, a + b, whole(a), whole(b)))
        for token, (rank, name, _, _) in made.items():
            ranks[token] = rank
            ids[token] = vocab[name]
        for token in self._unreachable(ranks, made):
            del ranks[token]
        self.fast = tiktoken.Encoding("word-ends", pat_str=rf"[^{_MARK}]+{_MARK}", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.zeros(max(ranks.values()) + 1, np.uint32)
        for token, rank in ranks.items():
            self.ids[rank] = ids[token]
        size = self.slow.get_vocab_size(with_added_tokens=True)
        size = max(size, *vocab.values()) + 1
        self.ends = np.zeros(size, bool)
        for name, i in vocab.items():
            bare = name.removesuffix("</w>")
            self.ends[i] = name.endswith("</w>") and bare != "" and bare[-1] in ".!?"

    @staticmethod
    def _unreachable(ranks: dict, made: dict) -> list[bytes]:
        """Tokens that greedy merging of their own bytes ends elsewhere than in their listed merge."""
        lost = []
        for token in sorted(made, key=lambda t: made[t][0]):
            rank, _, left, right = made[token]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60) if parts[i] + parts[i + 1] != token else 1 << 60)
                if ranks.get(parts[best] + parts[best + 1]) is None or parts[best] + parts[best + 1] == token:
                    break
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            if parts != [left, right]:
                lost.append(token)
        return lost

    def encode(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers, without special tokens."""
        text = text or ""
        if _PLAIN.search(text) or (self.special and self.special.search(text)):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)
        words = _WORDS.findall(text.lower())
        if not words:
            return np.zeros(0, np.uint32)
        return self.ids[np.array(self.fast.encode_ordinary(_MARK.join(words) + _MARK), np.uint32)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str, special_as_text: bool = False) -> WordTokenizer:
    return WordTokenizer(path, special_as_text)


def candidates(ids: np.ndarray, ends: np.ndarray, step: int, sentence: float, inside: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in a document where a window may end, ascending, with their penalties; its end is free."""
    n = ids.size
    at = np.flatnonzero(ends[ids[:-1]]) + 1 if n > 1 else np.zeros(0, np.int64)
    marks = np.concatenate(([0], at, [n]))
    gaps = np.diff(marks)
    wide = np.flatnonzero(gaps > step)
    fill = [np.arange(marks[i] + step, marks[i + 1], step) for i in wide.tolist()]
    places = np.concatenate([at, *fill, [n]]).astype(np.int64)
    costs = np.concatenate([np.full(at.size, sentence), *[np.full(f.size, inside) for f in fill], [0.0]])
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def best_cuts(places: list[int], costs: list[float], length: int) -> list[int]:
    """Window ends that minimise padding plus penalties; ``places`` ascend from above 0 with gaps up to ``length``.

    With f(i) the cost up to place i, f(j) = cost(j) + length - j + min(f(i) + i)
    over the places i in [j - length, j); ties take the earlier place.
    """
    total, back = [0.0] * (len(places) + 1), [0] * (len(places) + 1)
    at = [0, *places]
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])
    for j in range(1, len(at)):
        here = at[j]
        low = here - length
        while queue[0][1] < low:
            queue.popleft()
        best, _, i = queue[0]
        back[j] = i
        f = costs[j - 1] + length - here + best
        total[j] = f
        key = f + here
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, here, j))
    found, j = [], len(places)
    while j:
        found.append(at[j])
        j = back[j]
    return found[::-1]


def packed_stream(docs: Iterator[tuple[object, np.ndarray]], ends: np.ndarray, length: int, block: int, step: int, sentence: float, inside: float):
    """Lists of pieces ``(id, start, ids, doc_tokens, sequence, offset, used)`` of an ordered stream of documents.

    A block is packed when it is full; its last window stays open and goes on
    with the next block, so a partition has one unfilled tail at most.
    """
    held: list[tuple[object, np.ndarray, int, int]] = []  # id, the rest of its ids, place of that rest, all its ids
    sequence = 0

    def pack(last: bool):
        nonlocal held, sequence
        places, costs, base = [], [], 0
        for _, ids, _, _ in held:
            p, c = candidates(ids, ends, step, sentence, inside)
            places.append(p + base)
            costs.append(c)
            base += ids.size
        cuts = best_cuts(np.concatenate(places).tolist(), np.concatenate(costs).tolist(), length)
        if not last:
            cuts = cuts[:-1]
        out, rest, low, k = [], [], 0, 0
        base = 0
        for doc, ids, start, size in held:
            at = 0
            while at < ids.size and k < len(cuts):
                n = min(ids.size - at, cuts[k] - base - at)
                out.append((doc, start + at, ids[at : at + n], size, sequence, base + at - low, cuts[k] - low))
                at += n
                if base + at == cuts[k]:
                    low, k, sequence = cuts[k], k + 1, sequence + 1
            if at < ids.size:
                rest.append((doc, ids[at:], start + at, size))
            base += ids.size
        held = rest
        return out

    waiting = 0
    for doc, ids in docs:
        held.append((doc, ids, 0, ids.size))
        waiting += ids.size
        if waiting >= block:
            yield pack(False)
            waiting = sum(h[1].size for h in held)
    if held:
        yield pack(True)


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID,
    block: int = BLOCK_TOKENS, step: int = INSIDE_STEP, sentence: float = SENTENCE_PENALTY, inside: float = INSIDE_PENALTY, ids: bool = False,
    special_as_text: bool = False,
) -> DataFrame:
    """One row per piece, in sequences of at most ``length`` tokens.

    ``sequence_tokens`` is what the sequence holds and ``padded_tokens`` its
    stored length.  With ``ids``, the token ids themselves are returned too.
    """
    source = docs.select(id_col, F.col(text_col).alias("__text"))
    kind = source.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = tokenizer(tokenizer_path, special_as_text)
        first = TaskContext.get().partitionId() << 40
        end = np.array([end_id], np.uint32)
        typed: list[pa.DataType] = []

        def stream():
            for batch in batches:
                typed[:] = [batch.schema.field(0).type]
                for doc, text in zip(batch.column(0), batch.column(1)):
                    yield doc.as_py(), np.concatenate((words.encode(text.as_py()), end))

        for pieces in packed_stream(stream(), words.ends, length, block, step, sentence, inside):
            for i in range(0, len(pieces), 20000):
                part = pieces[i : i + 20000]
                raw = [p[2].astype("<u4", copy=False).tobytes() for p in part]
                used = [p[6] for p in part]
                columns = [
                    pa.array([p[0] for p in part], typed[0]), pa.array([p[1] for p in part], pa.int64()),
                    pa.array([p[2].size for p in part], pa.int64()), pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([p[3] for p in part], pa.int64()), pa.array([first + p[4] for p in part], pa.int64()),
                    pa.array([p[5] for p in part], pa.int64()), pa.array(used, pa.int64()),
                    pa.array([u if u & (u - 1) == 0 else length for u in used], pa.int64()),
                ]
                if ids:
                    columns.append(pa.array([p[2].tolist() for p in part], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens", *["ids"] * ids]
    fields = [T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in names[1:9])]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))
    return map_arrow(source, run, T.StructType(fields))
