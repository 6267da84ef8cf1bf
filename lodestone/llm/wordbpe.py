"""Word-level byte-pair encoding as the public word tokenizer does it, and its lexicon as an automaton.

The tokenizer normalises a text (NFC, white space as one space, lower case), splits it into pieces,
and merges each piece on its own, so the ids of a text are the ids of its pieces in order. Pieces are
looked up in a lexicon of the corpus's frequent pieces; all others are merged exactly.

The lexicon is a minimal acyclic automaton over the pieces' UTF-8 bytes: equal suffixes share states,
and each arc has as output the number of words that sort before those behind it, so the outputs along
a path add up to the word's place, and a table has the ids for each place. It is one block of bytes,
read through a memory map.
"""

from __future__ import annotations

import json
import heapq
import mmap
import re
import sys
import tempfile
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np

SPECIAL = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
#: Entries of a worker's memo of pieces, before it starts anew.
MEMO = 400_000
BYTES = [bytes([b]) for b in range(256)]
#: Bytes of a piece from which on it is merged by a heap; the rank of a pair that isn't merged.
LONG_PIECE, NEVER = 64, 1 << 29


def _latin(kind: str) -> str:
    """Class members: the lower-cased Latin-1 characters whose category starts with kind."""
    return "".join(re.escape(c) for c in map(chr, range(256)) if unicodedata.category(c).startswith(kind))


_L, _N, _S = _latin("L"), _latin("N"), r"\t-\r\x20\x85\xA0"
#: The tokenizer's pattern for texts of Latin-1 characters only.
LATIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


@lru_cache(1)
def byte_letters() -> list[str]:
    """Of each byte the printable character that stands for it: itself if printable in Latin-1, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, free = [], 0x100
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class WordBpe:
    """Pieces, ids and tokens of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.path = path
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in (self.ids | self.special).items():
            self.tokens[i] = token
        self.letters = byte_letters()
        self.inner, self.last = ([self.ids[c + end] for c in self.letters] for end in ("", "</w>"))
        self.bytes = {c: b for b, c in enumerate(self.letters)}

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; a special token's string is a piece of its own."""
        if "<|" in text and len(parts := SPECIAL.split(text)) > 1:
            return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._any(text)
        return LATIN_PIECES.findall(text.lower())

    def _any(self, text: str) -> list[str]:
        """By the library's own normaliser and splitter, back from its byte letters."""
        split = self.own.pre_tokenizer.pre_tokenize_str(self.own.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, piece)).decode("utf-8") for piece, _ in split]

    @cached_property
    def merges(self) -> tuple[list, list[int]]:
        """For each left id a look-up of its pairs' ranks by right id; and by rank the id of what the pair gives."""
        pairs = [p.split(" ") if isinstance(p, str) else p for p in json.load(open(self.path, encoding="utf-8"))["model"]["merges"]]
        ranks: list[dict[int, int]] = [{} for _ in self.tokens]
        for rank, (a, b) in enumerate(pairs):
            ranks[self.ids[a]][self.ids[b]] = rank
        return [r.get for r in ranks], [self.ids[a + b] for a, b in pairs]

    def merge(self, piece: str) -> list[int]:
        """Ids of a piece: of all neighbouring pairs the one with the lowest rank is merged, leftmost first, until none has a rank."""
        if piece in self.special:
            return [self.special[piece]]
        data = piece.encode("utf-8")
        parts = list(map(self.inner.__getitem__, data))
        parts[-1] = self.last[data[-1]]
        if len(parts) > LONG_PIECE:
            return self._merge_long(parts)
        rank_of, made = self.merges
        ranks = [rank_of[a](b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            parts[at] = here = made[best]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank_of[parts[at - 1]](here, NEVER)
            if at < len(ranks):
                ranks[at] = rank_of[here](parts[at + 1], NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same by a heap of pairs and links to the neighbours, in n log n steps."""
        n, (rank_of, made) = len(parts), self.merges
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := rank_of[parts[i]](parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or rank_of[parts[i]](parts[j], NEVER) != best:
                continue  # one of the two has been merged since
            parts[i], parts[j] = made[best], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := rank_of[parts[a]](parts[b], NEVER)) != NEVER:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def library_ids(self, piece: str) -> list[int]:
        """Ids of a piece by the library's model."""
        if piece in self.special:
            return [self.special[piece]]
        plain = piece.isascii() and piece.isprintable()
        return [t.id for t in self.own.model.tokenize(piece if plain else "".join([self.letters[b] for b in piece.encode("utf-8")]))]


class Lexicon:
    """A compiled lexicon; ``compile`` makes its bytes, ``find`` looks a word up."""

    FIELDS = ("first", "label", "target", "output", "final", "place", "ids")
    TYPES = (np.uint32, np.uint8, np.uint32, np.uint32, np.uint8, np.uint32, np.uint16)

    def __init__(self, blob: bytes):
        """The bytes go to a nameless file of this worker's and are read through a map of it."""
        self.map = None
        file = tempfile.TemporaryFile()
        file.write(blob)
        file.flush()
        self.map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        file.close()
        sizes, at = np.frombuffer(self.map, np.uint32, len(self.FIELDS)).tolist(), 4 * len(self.FIELDS)
        view = memoryview(self.map)
        for name, kind, n in zip(self.FIELDS, self.TYPES, sizes):
            width = kind().itemsize
            setattr(self, name, view[at : at + n * width].cast("BHI"[width // 2]))
            if name == "label":
                self.labels_at = at
            at += n * width

    @classmethod
    def compile(cls, words: dict[str, list[int]]) -> bytes:
        """Words (with their ids) are added in byte order; a state that can't change any more is replaced by its equal."""
        entries = sorted((w.encode("utf-8"), ids) for w, ids in words.items())
        register: dict[tuple, int] = {}
        states: list[tuple[bool, list[tuple[int, int]]]] = []  # frozen: final, arcs (label, state)
        counts: list[int] = []
        path: list[list] = [[False, []]]  # open states: final, arcs; path[i] is reached by the first i bytes
        last = b""

        def freeze(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, arcs = path.pop()
                key = (final, tuple(arcs))
                if key not in register:
                    register[key] = len(states)
                    states.append((final, arcs))
                    counts.append(final + sum(counts[s] for _, s in arcs))
                path[-1][1].append((last[len(path) - 1], register[key]))

        for word, _ in entries:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            freeze(common)
            path.extend([False, []] for _ in word[common:])
            path[-1][0] = True
            last = word
        freeze(0)
        states.append((path[0][0], path[0][1]))  # the start is the last state
        first, label, target, output, final = [0], [], [], [], []
        for is_final, arcs in states:
            before = int(is_final)
            for byte, state in arcs:
                label.append(byte)
                target.append(state)
                output.append(before)
                before += counts[state]
            final.append(is_final)
            first.append(len(label))
        place = np.concatenate([[0], np.cumsum([len(ids) for _, ids in entries], dtype=np.int64)])
        values = (first, label, target, output, final, place, [i for _, ids in entries for i in ids])
        arrays = [np.asarray(v, kind) for v, kind in zip(values, cls.TYPES)]
        return np.asarray([len(a) for a in arrays], np.uint32).tobytes() + b"".join(a.tobytes() for a in arrays)

    def find(self, word: str) -> list[int] | None:
        """The word's ids, or None if it isn't in the lexicon."""
        state, place, base, find = len(self.final) - 1, 0, self.labels_at, self.map.find
        first, output, target = self.first, self.output, self.target
        for byte in word.encode("utf-8"):
            arc = find(BYTES[byte], base + first[state], base + first[state + 1]) - base
            if arc < 0:
                return None
            place += output[arc]
            state = target[arc]
        if not self.final[state]:
            return None
        return self.ids[self.place[place] : self.place[place + 1]].tolist()


class Memo(dict):
    """piece -> made(piece), started anew when full, so that a worker's memory is bounded."""

    def __init__(self, made, most: int = MEMO):
        super().__init__()
        self.made, self.most = made, most

    def __missing__(self, piece: str):
        if len(self) >= self.most:
            self.clear()
        value = self[piece] = self.made(piece)
        return value


@lru_cache(2)
def tokenizer(path: str) -> WordBpe:
    """One per worker."""
    return WordBpe(path)


@lru_cache(2)
def library_memo(path: str) -> Memo:
    """A worker's pieces with their ids by the library, as little-endian 16-bit numbers; kept from task to task."""
    bpe = tokenizer(path)

    def made(piece: str) -> bytes:
        ids = array("H", bpe.library_ids(piece))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    return Memo(made)


def texts_of(batches: Iterable) -> Iterator[tuple[list, list[str]]]:
    """(doc ids, texts) of small runs of rows of Arrow batches (doc_id, text); null texts as empty."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
