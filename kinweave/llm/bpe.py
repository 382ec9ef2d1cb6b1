"""Byte-level BPE as a streaming transducer with bounded lookahead.

Text is cut into units (a run of white space and the run of other characters after it). No pre-token and so no
merge crosses a unit, so units can be emitted as soon as the next one begins. Inside a unit, pre-tokens are
encoded by merge rank. A pre-token of any length is read through a window: a token is stable, whatever follows,
once it ends at least `MergeTable.lookahead` bytes before the end of what has been read; stable tokens are
emitted and the window moves on. Units are read and emitted group by group, so that memory does not grow with the
text beyond a group, that window and a memo of recent units of bounded bytes. Decoding feeds token bytes to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import regex

PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
UNIT = regex.compile(r"\s*\S+|\s+")
CUT = re.compile(r"(?<=\S)[ \n]")
UNEVEN = re.compile(r"\s[ \n]|\x00")
NO_RANK = np.int32(2**31 - 1)
CHUNK = 1 << 16
LONG = 96
#: Bytes by which the window over a longer pre-token moves on.
STRIDE = 8192
#: Characters of text whose units are learned together; bytes of each of the two memos; characters of a unit that a memo takes.
GROUP, MEMO_BYTES, MEMO_UNIT = 1 << 21, 96 << 20, 512
#: What a memo entry takes beside its characters and ids, about.
ENTRY_BYTES = 160


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class MergeTable:
    """A byte-level merge list with vectorised lookup of ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_characters()
        value = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        ending = spec["model"].get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            if token not in self.special:
                self.token_bytes[i] = bytes(value[c] for c in (token.removesuffix(ending) if ending else token))
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.array([vocab[c] for c in letters], np.int32)
        self.last_id = np.array([vocab[c + ending] for c in letters], np.int32)
        self.length = np.array([len(b) for b in self.token_bytes], np.int64)
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], np.uint64)
        self._place(keys, np.array([vocab[a + b] for a, b in merges], np.int32))
        self.lookahead = sufficient_lookahead(
            [(self.token_bytes[vocab[a]], self.token_bytes[vocab[b]]) for a, b in merges]
        )

    def _place(self, keys: np.ndarray, merged: np.ndarray) -> None:
        """An open-addressing table of pairs; ``probes`` is the longest search."""
        self.bits = 19
        size = 1 << self.bits
        self.keys = np.full(size + 1, np.uint64(2**64 - 1))
        self.rank, self.merged = np.full(size + 1, NO_RANK), np.zeros(size + 1, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] == np.uint64(2**64 - 1)]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = keys[won], won, merged[won]
            left = np.setdiff1d(left, won)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a last slot of rank NO_RANK for pairs that never merge."""
        size = 1 << self.bits
        keys = ((left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))).ravel()
        slot = self._slot(keys)
        wrong = np.flatnonzero(self.keys[slot] != keys)
        slot[wrong[self.rank[slot[wrong]] == NO_RANK]] = size
        wrong = wrong[slot[wrong] < size]
        for _ in range(self.probes):
            if not len(wrong):
                break
            slot[wrong] = (slot[wrong] + 1) & (size - 1)
            wrong = wrong[self.keys[slot[wrong]] != keys[wrong]]
            slot[wrong[self.rank[slot[wrong]] == NO_RANK]] = size
            wrong = wrong[slot[wrong] < size]
        slot[wrong] = size
        return slot.reshape(left.shape)

    def encode_many(self, pretokens: list[bytes]) -> list[bytes]:
        """Token ids of each pre-token, as little-endian 32-bit integers."""
        out: list = [b""] * len(pretokens)
        order = sorted(range(len(pretokens)), key=lambda i: len(pretokens[i]))
        low = 0
        while low < len(order):
            high = min(len(order), low + max(1, (1 << 15) // max(1, len(pretokens[order[low]]))))
            while high - low > 1 and len(pretokens[order[high - 1]]) > 2 * max(4, len(pretokens[order[low]])):
                high = (low + high) // 2
            ids, count = self._merge([pretokens[i] for i in order[low:high]])
            data, row = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for k, (i, n) in enumerate(zip(order[low:high], count.tolist(), strict=True)):
                out[i] = data[k * row : k * row + 4 * n]
            low = high
        return out

    def encode_one(self, pretoken: bytes) -> np.ndarray:
        ids, count = self._merge([pretoken])
        return ids[0, : count[0]]

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word in a row, and their number. The pair of least rank is merged first, the leftmost of equal ones."""
        count = np.fromiter(map(len, words), np.int64, len(words))
        width = max(1, int(count.max()))
        ids = np.full((len(words), width + 1), -1, np.int64)
        ids[np.arange(width + 1) < count[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        whole = np.flatnonzero(count)
        ids[whole, count[whole] - 1] = self.last_id[[words[i][-1] for i in whole]]
        slot = self.find(ids[:, :-1], ids[:, 1:])
        rank = np.where(np.arange(width) < count[:, None] - 1, self.rank[slot], NO_RANK)
        active, place = np.arange(len(words)), np.arange(width + 1)
        while len(active):
            r = rank[active]
            best = r.argmin(1)
            going = r[np.arange(len(active)), best] < NO_RANK
            active, best = active[going], best[going]
            if not len(active):
                break
            new = self.merged[self._at(ids, active, best)]
            shift = place + (place > best[:, None])
            shift[:, -1] = width
            row = np.take_along_axis(ids[active], np.minimum(shift, width), 1)
            row[:, -1] = -1
            row[np.arange(len(active)), best] = new
            ranks = np.take_along_axis(rank[active], np.minimum(shift[:, :-1], width - 1), 1)
            ranks[:, -1] = NO_RANK
            ids[active] = row
            count[active] -= 1
            for at in (best - 1, best):
                ok = (at >= 0) & (at < count[active] - 1)
                fresh = np.full(len(active), NO_RANK)
                fresh[ok] = self.rank[self._at(ids, active[ok], at[ok])]
                touched = at >= 0
                ranks[np.flatnonzero(touched), at[touched]] = fresh[touched]
            rank[active] = ranks
        return ids, count

    def _at(self, ids: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.find(ids[rows, at], ids[rows, at + 1])

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        """Rank and merged id of each pair, by its key."""
        used = np.flatnonzero(self.rank < NO_RANK)
        return dict(zip(self.keys[used].tolist(), zip(self.rank[used].tolist(), self.merged[used].tolist(), strict=True), strict=True))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one word, in time that grows as its length and the logarithm of that: a heap of pairs over a linked list of tokens."""
        n, find = len(word), self.pairs.get
        if not n:
            return np.zeros(0, np.int64)
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last_id[word[-1]])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i) for i in range(n - 1) if (found := find(ids[i] << 32 | ids[i + 1]))]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            # the pair at this place may have been merged or changed meanwhile
            if ids[i] < 0 or j == n or not (found := find(ids[i] << 32 | ids[j])) or found[0] != rank:
                continue
            ids[i], ids[j] = found[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := find(ids[i] << 32 | ids[k]):
                    heappush(heap, (found[0], i))
            h = before[i]
            if h >= 0 and (found := find(ids[h] << 32 | ids[i])):
                heappush(heap, (found[0], h))
        return np.array([x for x in ids if x >= 0], np.int64)

    def encode_long(self, pretoken: bytes) -> Iterator[np.ndarray]:
        """Stable tokens of a pre-token of any length, window by window."""
        window, at = STRIDE + self.lookahead, 0
        while True:
            ids = self.merge_long(pretoken[at : at + window])
            if at + window >= len(pretoken):
                yield ids
                return
            ends = np.cumsum(self.length[ids])
            stable = int(np.searchsorted(ends, window - self.lookahead, "right"))
            yield ids[:stable]
            at += int(ends[stable - 1])


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which what follows can't change a token any more.

    Text that is appended changes earlier tokens only through a chain of merges of ever later rank: each
    joins what ends at the edge of the changed region (its left part) to what begins there, and moves the
    edge left by its left part. What begins at the new edge begins with that left part, so the next
    merge's right part does too. The longest such chain is found from the last merge to the first.
    """
    reach: dict[bytes, int] = {}
    longest = 0
    for left, right in reversed(merges):
        far = len(left) + reach.get(left, 0)
        longest = max(longest, far)
        for n in range(1, len(right) + 1):
            if reach.get(right[:n], 0) < far:
                reach[right[:n]] = far
    return longest + max(len(a) + len(b) for a, b in merges)


def units(text: str) -> list[str]:
    """The text cut where white space begins."""
    if UNEVEN.search(text):
        return UNIT.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, cut only before a space or line end that follows no white space."""
    low = 0
    while len(text) - low > size and (m := CUT.search(text, low + size)):
        yield text[low : m.start()]
        low = m.start()
    yield text[low:]


class Transducer:
    """Encodes texts to little-endian 32-bit ids with a memo of recent units of bounded size."""

    def __init__(self, path: str):
        self.table = MergeTable(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.held = 0
        self.special = re.compile("(" + "|".join(map(re.escape, self.table.special)) + ")") if self.table.special else None

    def learn(self, wanted: set[str]) -> None:
        """Puts the units of up to MEMO_UNIT characters into the young memo; when that is full it becomes the old one."""
        wanted = {u for u in wanted if len(u) <= MEMO_UNIT}
        missing = [u for u in wanted if u not in self.young]
        if self.held > MEMO_BYTES:
            self.old, self.young, self.held, missing = self.young, {"": b""}, 0, list(wanted)
        cut = {}
        for unit in missing:
            known = self.old.get(unit)
            if known is None:
                simple = unit[:1] == " " and unit[1:].isalpha()
                cut[unit] = [unit.encode()] if simple else [p.encode() for p in PATTERN.findall(unit)]
            else:
                self.young[unit] = known
        ids = self._short({p for own in cut.values() for p in own})
        for unit, own in cut.items():
            self.young[unit] = b"".join(ids[p] if p in ids else b"".join(self._long(p)) for p in own)
        self.held += sum(len(u) + len(self.young[u]) + ENTRY_BYTES for u in missing)

    def _short(self, pretokens: set[bytes]) -> dict[bytes, bytes]:
        short = [p for p in pretokens if len(p) <= LONG]
        return dict(zip(short, self.table.encode_many(short), strict=True))

    def _long(self, pretoken: bytes) -> Iterator[bytes]:
        return (x.astype("<u4").tobytes() for x in self.table.encode_long(pretoken))

    def direct(self, unit: str, size: int = 4096) -> Iterator[bytes]:
        """Ids of a unit of any length, without the memo: ``size`` pre-tokens at a time, long ones window by window."""
        found = (m.group().encode() for m in PATTERN.finditer(unit))
        while own := list(islice(found, size)):
            ids = self._short(set(own))
            for p in own:
                if p in ids:
                    yield ids[p]
                else:
                    yield from self._long(p)

    def known(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of learned units, in pieces."""
        long = [k for k, u in enumerate(parts) if len(u) > MEMO_UNIT]
        low = 0
        for k in long:
            yield b"".join(map(self.young.__getitem__, parts[low:k]))
            yield from self.direct(parts[k])
            low = k + 1
        yield b"".join(map(self.young.__getitem__, parts[low:] if low else parts))

    def segments(self, text: str) -> list[tuple[str, int | None]]:
        """The text cut at special tokens, each with its id; None for ordinary text."""
        if not self.special or "<" not in text:
            return [(text, None)]
        return [(s, self.table.special.get(s)) for s in self.special.split(text) if s]

    def encode(self, texts: Iterable[str]) -> Iterator[Iterator[bytes]]:
        """For each text, its ids in pieces, to be read before the next text's.

        Neighbouring texts of up to GROUP characters together are learned at once; a longer one is read, learned and
        emitted group by group.
        """
        held: list[str] = []
        for text in texts:
            if held and sum(map(len, held)) + len(text) > GROUP:
                yield from self._together(held)
                held = []
            if len(text) > GROUP:
                yield self.stream(text)
            else:
                held.append(text)
        yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        cut = [[(units(c), i) if i is None else ([], i) for s, i in self.segments(t) for c in (chunks(s) if i is None else [s])] for t in texts]
        self.learn(set(chain.from_iterable(u for own in cut for u, _ in own)))
        for own in cut:
            yield chain.from_iterable(self.known(u) if i is None else [int(i).to_bytes(4, "little")] for u, i in own)

    def stream(self, text: str, size: int = GROUP) -> Iterator[bytes]:
        """Ids of one text in pieces; no more than about ``size`` characters beyond a piece have been encoded when it is emitted."""
        for segment, special in self.segments(text):
            if special is not None:
                yield int(special).to_bytes(4, "little")
                continue
            for part in chunks(segment, size):
                own = units(part) if len(part) <= 2 * size else [part]
                self.learn(set(own))
                yield from self.known(own)

class Decoder:
    """Turns ids into text; bytes of an unfinished character wait for the next call."""

    def __init__(self, table: MergeTable):
        self.tokens = table.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        return self.state.decode(b"".join(map(self.tokens.__getitem__, ids.tolist())), last)


@cache
def transducer(path: str) -> Transducer:
    """One for each file and worker process."""
    return Transducer(path)
