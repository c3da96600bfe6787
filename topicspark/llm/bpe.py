"""Byte-pair encoding by speculation and verification, and decoding.

Words, cut by the vocabulary's pattern, are first tokenised greedily by longest match. That is the result of merging if
every pair of adjacent tokens is compatible, that is, if merging the two alone gives the two. All adjacent pairs are
checked at once; only words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import base64
import heapq
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from topicspark.llm import textvec as tv
from topicspark.llm.common import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a task remembers, and tokens of them; when there are more it keeps those of the most used that fill half of that.
REMEMBERED, REMEMBERED_TOKENS = 400_000, 4_000_000
#: Bytes of a word up to which merging scans all pairs, and up to which the words of a batch are matched in step.
SHORT, LONG = 64, 256
U64 = np.uint64
NONE = np.int64(1) << np.int64(40)


def read_ranks(path: str) -> list[bytes]:
    """Tokens in the order of their ranks from a file of lines: base64, rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merge(word: bytes, ranks: dict[bytes, int], below: int = 1 << 60) -> list[bytes]:
    """Exact merging: of the adjacent pairs that make a token, the lowest rank first, the leftmost of equals."""
    n = len(word)
    if n <= SHORT:
        return _merge_short(word, ranks, below)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], below)) < below]
    heapq.heapify(heap)
    while heap:
        _, i, j, k = heapq.heappop(heap)
        if end[i] != j or j >= n or end[j] != k:
            continue
        end[i], end[j] = k, -1
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : end[k]], below)) < below:
                heapq.heappush(heap, (r, i, k, end[k]))
        if i and (r := ranks.get(word[before[i] : k], below)) < below:
            heapq.heappush(heap, (r, before[i], i, k))
    out, i = [], 0
    while i < n:
        out.append(word[i : end[i]])
        i = end[i]
    return out


def _merge_short(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    n = len(word)
    cut = list(range(n + 1))
    get = ranks.get
    rank = [get(word[i : i + 2], below) for i in range(n - 1)]
    while rank:
        low = min(rank)
        if low >= below:
            break
        i = rank.index(low)
        del rank[i], cut[i + 1]
        if i < len(rank):
            rank[i] = get(word[cut[i] : cut[i + 2]], below)
        if i:
            rank[i - 1] = get(word[cut[i - 1] : cut[i + 1]], below)
    return [word[a:b] for a, b in zip(cut[:-1], cut[1:])]


@dataclass
class Vocabulary:
    tokens: list[bytes]
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    raw: np.ndarray
    hashes: np.ndarray
    ids: np.ndarray
    reachable: np.ndarray
    maybe: np.ndarray
    first: np.ndarray
    data: np.ndarray
    bytes: np.ndarray
    ranks: dict[bytes, int] = field(default_factory=dict)
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Token of each mixed hash, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        there = np.flatnonzero(self.maybe[h >> U64(42)])
        if len(there):
            own = h[there]
            top = (own >> U64(46)).astype(np.int64)
            at, upto = self.begin[top], self.begin[top + 1]
            # hashes of the same upper 18 bits are few and side by side
            while len(there):
                ok = self.hashes[at] == own
                out[there[ok]] = self.ids[at[ok]]
                more = np.flatnonzero(~ok & (at + 1 < upto))
                there, own, at, upto = there[more], own[more], at[more] + 1, upto[more]
        return out


def _raw_sums(data: np.ndarray) -> np.ndarray:
    power, _ = tv._powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * power[: len(data)], out=sums[1:])
    return sums


@lru_cache(2)
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """Tables of a vocabulary whose single bytes have the lowest ranks: each token's two last parts, hashes of all."""
    tokens = read_ranks(path)
    ranks = {t: i for i, t in enumerate(tokens)}
    n = len(tokens)
    if len(ranks) < n or any(len(t) != 1 for t in tokens[:256]) or any(len(t) < 2 for t in tokens[256:]):
        raise ValueError("the 256 single bytes must come first, and no token twice")
    left, right, reachable = np.arange(n), np.arange(n), np.ones(n, dtype=bool)
    for i in range(256, n):
        parts = merge(tokens[i], ranks, i)
        if len(parts) == 2:
            left[i], right[i] = ranks[parts[0]], ranks[parts[1]]
        else:
            reachable[i] = False
    length = np.array([len(t) for t in tokens])
    data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    first = np.concatenate(([0], np.cumsum(length)))
    sums = _raw_sums(data)
    _, inv = tv._powers(len(data) + 1)
    raw = (sums[first[1:]] - sums[first[:-1]]) * inv[first[:-1]]
    mixed = tv.mix(raw)
    order = np.argsort(mixed)
    if len(np.unique(mixed)) < n:
        raise ValueError("two tokens have one hash")
    maybe = np.zeros(1 << 22, dtype=bool)
    maybe[mixed >> U64(42)] = True
    begin = np.concatenate(([0], np.cumsum(np.bincount((mixed >> U64(46)).astype(np.int64), minlength=1 << 18)))).astype(np.int32)
    single = np.zeros(256, dtype=np.int64)
    single[[t[0] for t in tokens[:256]]] = np.arange(256)
    return Vocabulary(tokens, left, right, length, raw, mixed[order], order.astype(np.int64), reachable, maybe, first, data, single, ranks, begin)


def compatible(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the bytes of each pair of tokens gives just the two again.

    Going back through the merges that made the two, a pair of parts that meet at the border must not make a token of a
    lower rank than the next merge undone: it would have been merged before. Of equal ranks the left one is merged first.
    """
    power, _ = tv._powers(int(v.length.max()) + 1)
    ok = np.ones(len(a), dtype=bool)
    index, l, r = np.arange(len(a)), a.copy(), b.copy()
    limit = np.full(len(a), NONE)
    while len(index):
        joint = v.find(tv.mix(v.raw[l] + v.raw[r] * power[v.length[l]]))
        clash = (joint >= 0) & (joint < limit)
        ok[index[clash]] = False
        undo_left = l > r
        done = clash | np.where(undo_left, l < 256, r < 256)
        index, l, r, undo_left = index[~done], l[~done], r[~done], undo_left[~done]
        limit = np.where(undo_left, l, r + 1)
        l, r = np.where(undo_left, v.right[l], l), np.where(undo_left, r, v.left[r])
    return ok


def _longest(v: Vocabulary, sums: np.ndarray, inv: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, bytes) of the longest match from each place; only tokens that merging can make."""
    size = np.minimum(end - at, int(v.length.max()))
    token = np.full(len(at), -1, dtype=np.int64)
    todo = np.arange(len(at))
    while len(todo):
        p, q = at[todo], at[todo] + size[todo]
        t = v.find(tv.mix((sums[q] - sums[p]) * inv[p]))
        hit = t >= 0
        hit[hit] = v.reachable[t[hit]]
        token[todo[hit]] = t[hit]
        todo = todo[~hit]
        size[todo] -= 1
    return token, size


def merge_many(v: Vocabulary, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, token) of exact merging of many short words at once: a step merges one pair in each word that has one."""
    power, _ = tv._powers(int(v.length.max()) + 1)
    token, word = v.bytes[data], np.repeat(np.arange(len(first) - 1), np.diff(first))

    def ranks(at: np.ndarray) -> np.ndarray:
        l, r = token[at], token[at + 1]
        t = v.find(tv.mix(v.raw[l] + v.raw[r] * power[v.length[l]]))
        return np.where(t < 0, NONE, t)

    rank = np.full(len(token), NONE)
    inner = np.flatnonzero(word[1:] == word[:-1])
    rank[inner] = ranks(inner)
    words, tokens = [], []
    while len(token):
        begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        size = np.diff(np.append(begin, len(word)))
        low = np.minimum.reduceat(rank, begin)
        ended = np.repeat(low == NONE, size)
        words.append(word[ended])
        tokens.append(token[ended])
        hit = np.flatnonzero((rank == np.repeat(low, size)) & ~ended)
        if not len(hit):
            break
        # the leftmost of equals
        hit = hit[np.concatenate(([True], word[hit][1:] != word[hit][:-1]))]
        token[hit] = rank[hit]
        keep = ~ended
        keep[hit + 1] = False
        left = rank.copy()
        left[hit] = NONE
        now = np.cumsum(keep) - 1
        token, word, rank, hit = token[keep], word[keep], left[keep], now[hit]
        before = hit[hit > 0] - 1
        before = before[word[before] == word[before + 1]]
        after = hit[hit + 1 < len(word)]
        after = after[word[after] == word[after + 1]]
        rank[before], rank[after] = ranks(before), ranks(after)
    word = np.concatenate(words) if words else np.zeros(0, np.int64)
    order = np.argsort(word, kind="stable")
    return word[order], (np.concatenate(tokens) if tokens else np.zeros(0, np.int64))[order]


def greedy(v: Vocabulary, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, token) of the longest matches from the left. Words of up to LONG bytes go in step; in a longer one the
    matches from all places are found at once and then followed from the first."""
    sums = _raw_sums(data)
    _, inv = tv._powers(len(data) + 1)
    words, tokens = [], []
    for i in np.flatnonzero(end - start > LONG):
        parts = []
        for a in range(start[i], end[i], 1 << 16):
            at = np.arange(a, min(a + (1 << 16), end[i]))
            parts.append(_longest(v, sums, inv, at, np.full(len(at), end[i])))
        token, size = (np.concatenate(x) for x in zip(*parts))
        step, at, chain = size.tolist(), 0, []
        while at < len(step):
            chain.append(at)
            at += step[at]
        words.append(np.full(len(chain), i))
        tokens.append(token[chain])
    word = np.flatnonzero(end - start <= LONG)
    at = start[word]
    while len(word):
        token, size = _longest(v, sums, inv, at, end[word])
        words.append(word)
        tokens.append(token)
        at = at + size
        more = at < end[word]
        word, at = word[more], at[more]
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(np.concatenate(words), kind="stable")
    return np.concatenate(words)[order], np.concatenate(tokens)[order]


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens of all words one after the other, where each word's begin, and how many words had to be merged."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    return encode_runs(v, np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate(([0], np.cumsum(size))))


def encode_runs(v: Vocabulary, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """encode_words() of words that lie one after the other."""
    size = np.diff(first)
    sums = _raw_sums(data)
    _, inv = tv._powers(len(data) + 1)
    whole = v.find(tv.mix((sums[first[1:]] - sums[first[:-1]]) * inv[first[:-1]]))
    whole[size > v.length.max()] = -1
    rest = np.flatnonzero((whole < 0) & (size > 0))
    word, token = greedy(v, data, first[rest], first[rest + 1])
    same = word[1:] == word[:-1]
    pairs = np.unique((token[:-1][same] << np.int64(32)) | token[1:][same])
    good = compatible(v, pairs >> np.int64(32), pairs & np.int64(0xFFFFFFFF))
    bad_pair = np.zeros(max(len(token) - 1, 0), dtype=bool)
    if len(pairs):
        bad_pair[same] = ~good[np.searchsorted(pairs, (token[:-1][same] << np.int64(32)) | token[1:][same])]
    bad = np.zeros(len(rest), dtype=bool)
    bad[word[:-1][bad_pair]] = True
    failed = rest[bad]
    long = failed[size[failed] > SHORT].tolist()
    merged = [[v.ranks[t] for t in merge(data[first[i] : first[i + 1]].tobytes(), v.ranks)] for i in long]
    short = failed[size[failed] <= SHORT]
    short_word, short_token = merge_many(v, data[spread(first[short], size[short])], np.concatenate(([0], np.cumsum(size[short]))))
    ones = np.flatnonzero(whole >= 0)
    keep = ~bad[word]
    at = np.concatenate((ones, rest[word[keep]], short[short_word], np.repeat(np.array(long, dtype=np.int64), [len(m) for m in merged])))
    tokens = np.concatenate((whole[ones], token[keep], short_token, np.array([t for m in merged for t in m], dtype=np.int64)))
    order = np.argsort(at, kind="stable")
    return tokens[order].astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(at, minlength=len(size))))), len(failed)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... size[i] of them, for each i."""
    total = np.concatenate(([0], np.cumsum(size)))
    return np.arange(total[-1]) + np.repeat(first - total[:-1], size)


#: Bytes before which a piece may begin if the next one is no white space, and bytes that are white space or may begin one.
_CUT, _MAYBE_SPACE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_CUT[[10, 32]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: ASCII marks without the apostrophe, which may begin a word of letters.
_MARK = np.zeros(256, dtype=bool)
_MARK[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_MAYBE_SPACE[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes that PATTERN cuts alike, apart or in their text.

    A run of white space before a character is cut by PATTERN before its last character, so a piece may begin there.
    """
    n = len(data)
    border = np.zeros(n + 1, dtype=bool)
    border[1:n] = _CUT[data[:-1]] & ~_MAYBE_SPACE[data[1:]]
    border[offsets] = False
    border[:-1] = border[1:]
    border[offsets] = True
    start = np.flatnonzero(border[:n])
    return start, np.append(start[1:], n)[: len(start)]


class Codes:
    """Numbers by 64-bit hash; open addressing, half full at most."""

    def __init__(self) -> None:
        self.keys, self.values, self.n = np.zeros(1 << 12, U64), np.zeros(1 << 12, np.int32), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, or -1."""
        mask = U64(len(self.keys) - 1)
        out = np.full(len(h), -1, dtype=np.int64)
        todo, at = np.arange(len(h)), (h >> U64(20)) & mask
        while len(todo):
            key = self.keys[at]
            hit = key == h[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (key != 0)
            todo, at = todo[more], (at[more] + U64(1)) & mask
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Distinct hashes that are not there yet."""
        if (self.n + len(h)) * 2 > len(self.keys):
            old = self.keys != 0
            keys, held = self.keys[old], self.values[old]
            size = 1 << int((self.n + len(h)) * 2).bit_length()
            self.keys, self.values, self.n = np.zeros(size, U64), np.zeros(size, np.int32), 0
            self._put(keys, held)
        self._put(h, values)

    def _put(self, h: np.ndarray, values: np.ndarray) -> None:
        mask = U64(len(self.keys) - 1)
        self.n += len(h)
        at = (h >> U64(20)) & mask
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            mine = self.keys[at] == h
            self.values[at[mine]] = values[mine]
            h, values, at = h[~mine], values[~mine], (at[~mine] + U64(1)) & mask


class Encoder:
    """Encodes texts; remembers the tokens of the pieces it has met."""

    def __init__(self, v: Vocabulary, pattern: str = PATTERN):
        self.v, self.pattern = v, regex.compile(pattern)
        self.failed = 0
        self.plain = pattern == PATTERN
        self.codes = Codes()
        self.first, self.size, self.tokens, self.used = (np.zeros(0, np.int32) for _ in range(4))

    def _forget(self) -> None:
        """Keeps the pieces most used, without those met once, up to half of what may be remembered."""
        h, there = np.zeros(len(self.first), dtype=U64), self.codes.keys != 0
        h[self.codes.values[there]] = self.codes.keys[there]
        keep = np.argsort(-self.used, kind="stable")[: REMEMBERED // 2]
        keep = keep[(self.used[keep] > 1) & (np.cumsum(self.size[keep]) <= REMEMBERED_TOKENS // 2)]
        size = self.size[keep]
        self.tokens = self.tokens[spread(self.first[keep].astype(np.int64), size.astype(np.int64))]
        # what was used long ago counts less
        self.first, self.size, self.used = (np.cumsum(size) - size).astype(np.int32), size, self.used[keep] // 2
        self.codes = Codes()
        self.codes.add(h[keep], np.arange(len(keep)))

    def _words(self, text: str) -> list[str]:
        # letters after a space are one word of the pattern
        return [text] if self.plain and (text[1:] if text[:1] == " " else text).isalpha() else self.pattern.findall(text)

    def _tokens_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts one after the other, and where each one's begin."""
        cut = [self._words(t) for t in texts]
        words = list(dict.fromkeys(w for c in cut for w in c))
        at = dict(zip(words, range(len(words))))
        tokens, first, failed = encode_words(self.v, [w.encode("utf-8", "surrogatepass") for w in words])
        self.failed += failed
        which = np.array([at[w] for c in cut for w in c], dtype=np.int64)
        size = first[1:] - first[:-1]
        edge = np.concatenate(([0], np.cumsum(size[which])))
        upto = np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)
        return tokens[spread(first[which], size[which])], edge[upto]

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> None:
        # ASCII letters, with or without a space before them, are one word and marks after them another, without the pattern
        other = np.append(np.flatnonzero(~_LETTER[data]), len(data))
        marks = np.concatenate(([0], np.cumsum(_MARK[data])))
        inner = start + (data[start] == 32)
        cut = np.minimum(other[np.searchsorted(other, inner)], end)
        plain = (inner < cut) & (marks[end] - marks[cut] == end - cut)
        size = np.stack(((cut - start)[plain], (end - cut)[plain]), axis=1).ravel()
        own, edge, failed = encode_runs(self.v, data[spread(start[plain], (end - start)[plain])], np.concatenate(([0], np.cumsum(size))))
        edge = edge[::2]
        self.failed += failed
        raw = data.tobytes()
        rest, upto = self._tokens_of([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[~plain].tolist(), end[~plain].tolist())])
        new = np.concatenate((np.diff(edge), np.diff(upto))).astype(np.int32)
        self.codes.add(np.concatenate((h[plain], h[~plain])), np.arange(len(self.first), len(self.first) + len(new)))
        self.first = np.concatenate((self.first, (np.cumsum(new) - new + len(self.tokens)).astype(np.int32)))
        self.size = np.concatenate((self.size, new))
        self.used = np.concatenate((self.used, np.zeros(len(new), np.int32)))
        self.tokens = np.concatenate((self.tokens, own, rest))

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts (UTF-8, one after the other) one after the other, and where each text's begin. Pieces are
        known by a hash of 64 bits; the tokens' bytes are compared with the text's, which shows if two share one."""
        if not self.plain:
            raw = data.tobytes()
            return self._tokens_of([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(offsets[:-1], offsets[1:])])
        if self.codes.n > REMEMBERED or len(self.tokens) > REMEMBERED_TOKENS:
            self._forget()
        start, end = pieces(data, offsets)
        sums = _raw_sums(data)
        _, inv = tv._powers(len(data) + 1)
        h = tv.mix((sums[end] - sums[start]) * inv[start]) | U64(1)
        code = self.codes.find(h)
        unknown = np.flatnonzero(code < 0)
        if len(unknown):
            new, at = np.unique(h[unknown], return_index=True)
            self._learn(data, start[unknown[at]], end[unknown[at]], new)
            code[unknown] = self.codes.find(h[unknown])
        self.used += np.bincount(code, minlength=len(self.used)).astype(np.int32)
        size = self.size[code].astype(np.int64)
        tokens = self.tokens[spread(self.first[code], size)]
        edge = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, offsets)]
        wrong = self._differ(tokens, edge, data, offsets)
        if len(wrong):
            raw = data.tobytes()
            lists = [tokens[a:b] for a, b in zip(edge[:-1], edge[1:])]
            for i in wrong:
                lists[i] = self._tokens_of([raw[offsets[i] : offsets[i + 1]].decode("utf-8", "surrogatepass")])[0]
            tokens, edge = np.concatenate(lists), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
        return tokens, edge

    def _differ(self, tokens: np.ndarray, edge: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        back, begin = decode(self.v, tokens, edge)
        if len(back) == len(data) and np.array_equal(begin, offsets) and np.array_equal(back, data):
            return np.zeros(0, np.int64)
        return np.array([i for i in range(len(offsets) - 1) if not np.array_equal(back[begin[i] : begin[i + 1]], data[offsets[i] : offsets[i + 1]])], dtype=np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        return self.encode_bytes(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))


def decode(v: Vocabulary, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and where each text's begin."""
    size = v.length[tokens]
    edge = np.concatenate(([0], np.cumsum(size)))
    return v.data[spread(v.first[tokens], size)], edge[first]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder_of(v: Vocabulary, path: str, pattern: str) -> Encoder:
    """The encoder of this Python worker, which keeps what it has learnt from one task to the next."""
    key = (path, pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(v, pattern)
    return _encoders[key]


def encode_texts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, tokens, round_trip`` of every document; round_trip: decoding gives the text again.

    A null text has null tokens, none of them, and no round trip; an empty text has an empty list. Texts and words of any
    length are encoded whole. Repeated rows are encoded alike; of equal ranks the leftmost pair is merged first. Strings
    of special tokens are ordinary text. An empty table gives no rows. Other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    own = docs.select("doc_id", "text")

    def encode(batches):
        v = sent.value
        encoder = encoder_of(v, path, pattern)
        for batch in batches:
            text = batch.column("text")
            for at, to, data, offsets in tv.chunks(text):
                part = text.slice(at, to - at)
                tokens, first = encoder.encode_bytes(data, offsets)
                back, begin = decode(v, tokens, first)
                if len(back) == len(data) and np.array_equal(begin, offsets) and np.array_equal(back, data):
                    same = np.ones(to - at, dtype=bool)
                else:
                    same = np.array([np.array_equal(back[begin[i] : begin[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(to - at)])
                null = np.asarray(part.is_null())
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32(), mask=np.concatenate((null, [False]))), pa.array(tokens))
                n = pa.array(np.diff(first).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, to - at), n, lists, pa.array(same, mask=null)], names=["doc_id", "n_tokens", "tokens", "round_trip"]
                )

    return own.mapInArrow(encode, f"doc_id {dict(own.dtypes)['doc_id']}, n_tokens int, tokens array<int>, round_trip boolean")


def decode_tokens(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, text`` of rows with a column ``tokens``; a null list gives a null text, bytes that aren't UTF-8 the
    replacement character. Null elements and numbers that are no token are left out, as if they weren't in the list."""
    sent = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))
    own = encoded.select("doc_id", "tokens")

    def back(batches):
        for batch in batches:
            lists = batch.column("tokens")
            flat = np.asarray(pc.fill_null(lists.flatten(), -1)).astype(np.int64)
            size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
            known = (flat >= 0) & (flat < len(sent.value.tokens))
            upto = np.concatenate(([0], np.cumsum(known)))[np.concatenate(([0], np.cumsum(size)))]
            data, begin = decode(sent.value, flat[known], upto)
            raw, null = data.tobytes(), np.asarray(lists.is_null())
            texts = [None if null[i] else raw[begin[i] : begin[i + 1]].decode("utf-8", "replace") for i in range(len(size))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return own.mapInArrow(back, f"doc_id {dict(own.dtypes)['doc_id']}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"))
