"""Byte-level BPE by corpus-level merge replay.

The words of a whole block of documents are laid out in one token array. An inverted index leads from each
mergeable token pair (keyed by the rank of its merge) to the positions where it stands in any word of the block;
merges are replayed in rank order over all those positions at once, and each merge only touches the two
neighbours of the merged pair, whose new pairs enter the index. No word is scanned again for each merge.

The operator needs no shuffle: blocks are narrow, the rank table is broadcast (its size is that of the
vocabulary file, about 1 MB, whatever the corpus), and memory is bounded by the block and by a bounded memo of
words already replayed.

Defined cases: a null text is an empty text and has no ids; ids come back for every row, repeated rows included;
an empty table gives an empty table; other columns are carried along unchanged, and where a column has the
name of a result the result wins.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_bytes, equal_spans, hash_words, memory_for, trim, unused

#: Words in each generation of a worker's memo, beyond those of one block.
MEMO_ENTRIES = 200_000
#: Tokens below this id merge by table and by arrays.
DENSE = 4096
NEVER = 1 << 62
#: The same two bounds of a lean encoder.
LEAN_DENSE, LEAN_ENTRIES = 1024, 40_000
#: Words of more bytes are replayed position by position.
LONG = 64
#: Fixed value: the pattern of byte-level BPE by which each single space begins a match.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MARKS = frozenset(".,;:!?")
#: Bytes of text replayed together.
BLOCK_BYTES, LEAN_BLOCK_BYTES = 12_000_000, 5_000_000

class Memo:
    """A bounded memo in two generations: what a block needs moves to the present one, the past one is dropped."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.now: dict[str, bytes] = {}
        self.past: dict[str, bytes] = {}
        self.entries = entries

    def missing(self, keys: set[str]) -> set[str]:
        """Which of the keys a block needs are unknown; the known ones stand in `now` afterwards."""
        if len(self.now) > self.entries:
            self.past, self.now = self.now, {}
        keys = keys.difference(self.now)
        known = keys.intersection(self.past)
        self.now.update({k: self.past[k] for k in known})
        return keys - known


class Replay:
    """Encoder over the merges of a vocabulary; encode_rows() replays the merges of all words of a block together.

    vocab: the bytes of each id. pairs: (left << 32 | right) to the id that the two ids merge into; merges of smaller
    ids go first. whole: a word that is a token as a whole is that token, whatever its merges.
    """

    def __init__(self, vocab: list[bytes], pairs: dict[int, int], pattern: str, whole: bool, lean: bool = False, added: dict[str, int] | None = None):
        import regex

        #: Added tokens stand for their literal text wherever it occurs, before any match.
        self.added = added or {}
        self.literal = regex.compile(b"|".join(regex.escape(t.encode()) for t in sorted(self.added, key=len, reverse=True))) if self.added else None

        self.width = LEAN_DENSE if lean else DENSE
        self.block = LEAN_BLOCK_BYTES if lean else BLOCK_BYTES

        self.find = regex.compile(pattern).findall
        #: Whether rows can be cut at spaces, which holds for this pattern only.
        self.spaced = pattern == SPACED
        self.vocab, self.pairs, self.whole = vocab, pairs, whole
        self.id_of = {t: i for i, t in enumerate(vocab) if t}
        self.single = np.array([self.id_of[bytes([b])] for b in range(256)])
        if self.single.max() >= self.width:
            raise ValueError(f"the single bytes must have ids below {self.width}")
        #: The pairs of ids below `width` as a table; `none` where there is no merge.
        self.none = 0xFFFF if len(vocab) < 0xFFFF else 0xFFFFFFFF
        self.dense = np.full((self.width, self.width), self.none, dtype=np.uint16 if self.none == 0xFFFF else np.uint32)
        for pair, rank in pairs.items():
            if pair >> 32 < self.width and pair & 0xFFFFFFFF < self.width:
                self.dense[pair >> 32, pair & 0xFFFFFFFF] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.words = Memo(LEAN_ENTRIES if lean else MEMO_ENTRIES)

    @classmethod
    def of_ranks(cls, raw: bytes, pattern: str, lean: bool = False) -> Replay:
        """From lines of base64 token and rank; every cut of a token into two tokens merges into it."""
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x)}
        vocab = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            vocab[rank] = token
        pairs = {ranks[t[:i]] << 32 | ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        return cls(vocab, pairs, pattern, True, lean)

    @classmethod
    def of_json(cls, raw: bytes, pattern: str, lean: bool = False) -> Replay:
        """From a tokenizers file of a byte-level BPE whose ids follow the order of its merges."""
        tokenizer = json.loads(raw)
        model = tokenizer["model"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        ids = model["vocab"]
        vocab = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            if all(c in byte_of for c in token):
                vocab[i] = bytes(byte_of[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [ids[a + b] for a, b in merges]
        if made != sorted(made):
            raise ValueError("ids don't follow the order of the merges")
        pairs: dict[int, int] = {}
        for (a, b), i in zip(merges, made):
            pairs.setdefault(ids[a] << 32 | ids[b], i)
        added = {t["content"]: t["id"] for t in tokenizer.get("added_tokens") or []}
        if any(t.get(k) for t in tokenizer.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that depend on their surroundings are not read")
        for content, i in added.items():
            vocab.extend([b""] * (i + 1 - len(vocab)))
            vocab[i] = content.encode()
        return cls(vocab, pairs, pattern, False, lean, added)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Token ids of each word, as little-endian unsigned 32-bit integers.

        The index holds, for each rank, the positions of the pairs that merge into it. Merges of ranks below DENSE
        stand at many positions and are applied rank by rank to all of them; the rest follow in waves. In one pass over a rank only the first position of each word is merged: should the merge make a pair of a lower
        rank in that word, that pair goes first, as it does when each word is encoded by itself.
        """
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            out = self.replay([w if len(w) <= LONG else b"" for w in words])
            for i, ids in zip(long, self._replay_long([words[i] for i in long])):
                out[i] = ids
            return out
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        n = len(raw)
        if not n:
            return [b""] * len(words)
        starts = np.cumsum(lengths) - lengths
        token = self.single[raw]
        owner = np.repeat(np.arange(len(words)), lengths)
        after = np.arange(1, n + 1)
        after[starts[lengths > 0] + lengths[lengths > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[starts[lengths > 0]] = -1
        places = np.flatnonzero(after >= 0)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(ranks: np.ndarray, at: np.ndarray) -> None:
            known = ranks != self.none
            ranks, at = ranks[known], at[known]
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            edges = [0, *(np.flatnonzero(np.diff(ranks)) + 1).tolist(), len(ranks)] if len(ranks) else []
            for x, y in zip(edges, edges[1:]):
                rank = int(ranks[x])
                if rank in index:
                    index[rank].append(at[x:y])
                else:
                    index[rank] = [at[x:y]]
                    heappush(heap, rank)

        enter(self.dense[token[places], token[places + 1]], places)
        while heap and heap[0] < self.width:
            rank = heappop(heap)
            found = index.pop(rank)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            at = at[(token[at] >= 0) & (after[at] >= 0)]
            at = at[self.dense[token[at], token[after[at]]] == rank]
            if not len(at):
                continue
            own = owner[at]
            first = np.ones(len(at), dtype=bool)
            first[1:] = own[1:] != own[:-1]
            if not first.all():
                index[rank] = [at[~first]]
                heappush(heap, rank)
                at = at[first]
            right = after[at]
            next_, previous = after[right], before[at]
            token[at], token[right], after[at] = rank, -1, next_
            more = next_ >= 0
            before[next_[more]] = at[more]
            less = previous >= 0
            enter(
                np.concatenate([self.dense[rank, token[next_[more]]], self.dense[token[previous[less]], rank]]),
                np.concatenate([at[more], previous[less]]),
            )
        if index:
            self._replay_rest(token, owner)
        kept = token >= 0
        counts = np.concatenate([[0], np.cumsum(kept)])
        flat = token[kept].astype("<u4").tobytes()
        return [flat[4 * x : 4 * y] for x, y in zip(counts[starts].tolist(), counts[starts + lengths].tolist())]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair of ids; NEVER where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], NEVER)

    def _replay_rest(self, token: np.ndarray, owner: np.ndarray) -> None:
        """All merges that are left, in waves: the first pair of the lowest rank of each word, in every word at once.

        From here on a rank stands at a few positions only, so the index is kept by word instead of by rank: the rank
        of the pair at each position, of which a merge changes that of the pair itself and of its left neighbour.
        """
        place = np.flatnonzero(token >= 0)
        ids, word = token[place].astype(np.int64), owner[place]
        ranks = np.full(len(ids), NEVER, dtype=np.int64)
        inside = np.flatnonzero(word[:-1] == word[1:])
        ranks[inside] = self._ranks(ids[inside], ids[inside + 1])
        while len(ids):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lowest = np.minimum.reduceat(ranks, begin)
            going = np.repeat(lowest < NEVER, np.diff(begin, append=len(ids)))
            if not going.all():  # words that are done leave
                place, ids, word, ranks = place[going], ids[going], word[going], ranks[going]
                if not len(ids):
                    break
                lowest = lowest[lowest < NEVER]
                begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            hits = np.flatnonzero(ranks == np.repeat(lowest, np.diff(begin, append=len(ids))))
            hits = hits[np.concatenate([[True], word[hits[1:]] != word[hits[:-1]]])]
            ids[hits] = ranks[hits]
            token[place[hits]] = ranks[hits]
            token[place[hits + 1]] = -1
            keep = np.ones(len(ids), dtype=bool)
            keep[hits + 1] = False
            now = np.cumsum(keep) - 1
            place, ids, word, ranks = place[keep], ids[keep], word[keep], ranks[keep]
            touched = np.concatenate([now[hits], now[hits] - 1])
            touched = touched[touched >= 0]
            ranks[touched] = NEVER
            touched = touched[touched + 1 < len(ids)]
            touched = touched[word[touched] == word[touched + 1]]
            ranks[touched] = self._ranks(ids[touched], ids[touched + 1])

    def _replay_long(self, words: list[bytes]) -> list[bytes]:
        """Token ids of long words: the same index by rank, taken position by position, so that a word with n merges
        takes n steps and not n passes."""
        rank_of, single = self.pairs.get, self.single.tolist()
        tokens = [single[b] for w in words for b in w]
        owner = [i for i, w in enumerate(words) for _ in w]
        ends = np.cumsum([len(w) for w in words]).tolist()
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        for e in ends:
            after[e - 1] = -1
            if e < n:
                before[e] = -1
        index: dict[int, list[int]] = {}
        heap: list[int] = []

        def enter(left: int, right: int, at: int) -> int:
            rank = rank_of(tokens[left] << 32 | tokens[right])
            if rank is None:
                return NEVER
            if rank not in index:
                index[rank] = []
                heappush(heap, rank)
            index[rank].append(at)
            return rank

        for i in range(n):
            if after[i] >= 0:
                enter(i, i + 1, i)
        while heap:
            rank = heappop(heap)
            held: set[int] = set()  # words that got a pair of a lower rank, which has to go first
            later: list[int] = []
            for i in sorted(index.pop(rank)):
                j = after[i]
                if j < 0 or tokens[i] < 0 or rank_of(tokens[i] << 32 | tokens[j]) != rank:
                    continue  # a neighbour was merged meanwhile
                if owner[i] in held:
                    later.append(i)
                    continue
                k, p = after[j], before[i]
                tokens[i], tokens[j], after[i] = rank, -1, k
                if k >= 0:
                    before[k] = i
                if (k >= 0 and enter(i, k, i) < rank) | (p >= 0 and enter(p, i, p) < rank):
                    held.add(owner[i])
            if later:
                if rank not in index:
                    index[rank] = []
                    heappush(heap, rank)
                index[rank] += later
        begin = [0, *ends]
        return [np.array([t for t in tokens[x:y] if t >= 0], dtype="<u4").tobytes() for x, y in zip(begin, ends)]

    def _learn(self, words: set[str]) -> None:
        """Replay the words that the memo lacks."""
        todo: list[str] = []
        for word in words:
            known = self.id_of.get(word.encode()) if self.whole else self.added.get(word)
            if known is None:
                todo.append(word)
            else:
                self.words.now[word] = known.to_bytes(4, "little")
        self.words.now.update(zip(todo, self.replay([w.encode() for w in todo])))

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 rows (all ids, and where each row's begin) of one block."""
        rows, offsets = offsets, self._at_literals(raw, offsets)
        cuts = _chunk_starts(raw, offsets) if self.spaced else np.unique(offsets[:-1][offsets[:-1] < offsets[1:]])
        ends = np.append(cuts[1:], len(raw))
        data = raw.tobytes()
        inverse, distinct = pd.factorize(hash_words(raw, cuts, ends, 0))
        first = np.empty(len(distinct), dtype=np.int64)
        first[inverse[::-1]] = np.arange(len(cuts) - 1, -1, -1)
        sizes, like = ends - cuts, first[inverse]
        if (sizes != sizes[like]).any() or not equal_spans(raw, cuts, cuts[like], sizes).all():  # told apart by their bytes
            texts: dict[bytes, int] = {}
            inverse = np.fromiter((texts.setdefault(data[a:b], len(texts)) for a, b in zip(cuts.tolist(), ends.tolist())), np.int64, len(cuts))
            first = np.unique(inverse, return_index=True)[1]
        texts = [data[a:b].decode() for a, b in zip(cuts[first].tolist(), ends[first].tolist())]
        split = {i: m for i, t in enumerate(texts) if (m := self._matches(t)) is not None}  # others are one match
        words = set(texts).difference([texts[i] for i in split])
        words.update(*split.values())
        self._learn(self.words.missing(words))
        ids_of = self.words.now.__getitem__
        made = [None if i in split else ids_of(t) for i, t in enumerate(texts)]
        for i, matches in split.items():
            made[i] = b"".join(map(ids_of, matches))
        sizes = np.fromiter(map(len, made), dtype=np.int64, count=len(made)) // 4
        flat = np.frombuffer(b"".join(made), dtype="<u4")
        del split, made, words, texts, like
        begin = np.cumsum(sizes) - sizes
        lengths = sizes[inverse]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        ids = np.empty(int(edges[-1]), dtype="<u4")
        step = 500_000
        for a in range(0, len(lengths), step):  # in steps, so that the index arrays stay small
            part = lengths[a : a + step]
            low, high = int(edges[a]), int(edges[min(a + step, len(lengths))])
            ids[low:high] = flat[np.repeat(begin[inverse[a : a + step]] - (edges[a : a + len(part)] - low), part) + np.arange(high - low)]
        return ids, edges[np.searchsorted(cuts, rows)]

    def _at_literals(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Row offsets with the edges of added tokens, which are read as rows of their own."""
        if not self.literal or not (found := [m.span() for m in self.literal.finditer(raw)]):
            return offsets
        a, b = np.array(found).T
        inside = np.searchsorted(offsets, a, side="right") == np.searchsorted(offsets, b, side="left")  # not over two rows
        return np.sort(np.concatenate([offsets, a[inside], b[inside]]))

    def _matches(self, chunk: str) -> list[str] | None:
        """The pattern's matches; None where the whole chunk is one, as most are."""
        if self.spaced and (chunk.isalpha() or chunk[0] == " " and chunk[1:].isalpha()) or chunk in self.added:
            return None
        found = self.find(chunk)
        return None if found == [chunk] else found

    def encode(self, text: str) -> list[int]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        return self.encode_rows(raw, np.array([0, len(raw)]))[0].tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.__getitem__, ids.tolist()))


_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in MARKS]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_SPACE = np.zeros(256, dtype=bool)
_ASCII_SPACE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: First bytes of the UTF-8 sequences among which there is white space (U+0085, U+00A0, U+1680, U+2000.., U+3000).
_MAYBE_SPACE = np.zeros(256, dtype=bool)
_MAYBE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def _chunk_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where to cut rows so that each chunk has the same matches alone as in its row.

    A space between two characters that are not white space begins a match and ends the one before, so it is a
    place to cut. Where a neighbour may be white space beyond ASCII there is no cut, which is always right.

    A line feed before a character that is no white space is a match of its own, whatever stands before it: the
    pattern leaves the last character of a run of white space to a match of its own, and no match but one of white
    space holds a line feed. So there is a cut on both sides of it. No match holds a letter and a mark, so there is a
    cut between an ASCII letter and a mark.
    """
    n = len(raw)
    cut = np.zeros(n, dtype=bool)
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    feed = np.flatnonzero(raw == 0x0A)
    feed = feed[feed + 1 < n]
    behind = raw[feed + 1]
    feed = feed[~_ASCII_SPACE[behind] & ~_MAYBE_SPACE[behind] & ~cut[feed + 1]]  # the next byte is of the same row
    at = np.flatnonzero(raw == 0x20)
    at = at[(at > 0) & (at + 1 < n)]
    before, behind = raw[at - 1], raw[at + 1]
    fine = ~_ASCII_SPACE[before] & ~_ASCII_SPACE[behind] & ~_MAYBE_SPACE[behind]
    two, three = raw[np.maximum(at - 2, 0)], raw[np.maximum(at - 3, 0)]
    multi = before >= 0x80
    fine &= ~(multi & ((two == 0xC2) | ((two >= 0x80) & (two < 0xC0) & _MAYBE_SPACE[three])))
    cut[at[fine]] = True
    mark = np.flatnonzero(_MARK[raw])
    mark = mark[mark > 0]
    cut[mark[_LETTER[raw[mark - 1]]]] = True
    cut[feed] = True
    cut[feed + 1] = True
    return np.flatnonzero(cut)


def blocks(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Slices of rows of about `most` bytes together."""
    begin, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > most:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def encoded(work: Replay, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row slices of an Arrow string column with their ids and the edges of each row's ids."""
    raw, offsets = column_bytes(column)
    for a, b in blocks(np.diff(offsets), work.block):
        part = raw[offsets[a] : offsets[b]]
        yield a, b, *work.encode_rows(part, offsets[a : b + 1] - offsets[a])
        trim()


def shared_replay(shared, pattern: str, lean: bool = False) -> Replay:
    """One encoder for each vocabulary in a Python worker, so that its memo lasts over tasks.

    lean: with a small table and memo, where memory is short; the ids are the same.
    """
    raw, made = shared.value, memory_for("bpe")
    key = (hash(raw), pattern, lean)
    if key not in made:
        made[key] = (Replay.of_json if raw.lstrip()[:1] == b"{" else Replay.of_ranks)(raw, pattern, lean)
    return made[key]


def share(df: DataFrame, path: str):
    """The vocabulary file, read by the driver and broadcast: its size does not depend on the corpus."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a binary column of token ids (little-endian unsigned 32-bit) of the whole text."""
    shared = share(df, path)

    def run(column):
        for a, b, ids, edges in encoded(shared_replay(shared, pattern), column):
            flat, at = ids.tobytes(), (4 * edges).tolist()
            yield a, b, [flat[x:y] for x, y in zip(at, at[1:])]

    return _narrow(df, text, out, run, "string")


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a binary column of the bytes that the ids stand for; null ids decode to nothing."""
    shared = share(df, path)

    def run(column):
        work = shared_replay(shared, "")
        yield 0, len(column), [work.decode(np.frombuffer(x or b"", dtype="<u4")) for x in column.to_pylist()]

    return _narrow(df, ids, out, run, "binary")


def _narrow(df: DataFrame, column: str, out: str, work, kind: str) -> DataFrame:
    import pyarrow as pa

    rest = [c for c in df.columns if c != out]
    base = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{column}`").cast(kind).alias(unused("__in", rest)))
    schema = df.select(*[F.col(f"`{c}`") for c in rest]).schema.add(out, "binary")

    def run(batches):
        for batch in batches:
            for a, b, made in work(batch.column(len(rest))):
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(a, b - a) for i in range(len(rest))], pa.array(made, pa.binary())], names=[*rest, out])

    return base.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode whole texts, decode the ids, and return sizes and digests of both: one row for each row of df."""
    import pyarrow as pa

    shared = share(df, path)

    def run(batches):
        work = shared_replay(shared, pattern)
        for batch in batches:
            for a, b, ids, edges in encoded(work, batch.column(1)):
                rows = [ids[x:y] for x, y in zip(edges.tolist(), edges[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([len(x) for x in rows], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                        pa.array([hashlib.sha256(work.decode(x)).hexdigest() for x in rows], pa.string()),
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kept = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    schema = kept.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return kept.mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query 1: every document through the multilingual byte-level vocabulary and back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
