"""BPE encoding and decoding of whole texts, equal to the public tokenizers library's for word-level BPE files.

Words that a batch has not met before are merged together: their symbols lie in one flat array, and each round finds
every word's lowest-ranked pair by binary search over the sorted pair keys and merges it wherever it stands.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from colloquy.llm.common import encoded

#: White space as the file's normalizer means it: Unicode White_Space, without the separators 1C to 1F.
WHITE = re.compile("[" + "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
#: The file's pre-tokenizer over normalized text; the second is the same for texts of ASCII and Latin-1 letters.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^ \p{L}\p{N}]+")
LATIN = re.compile("[\x00-\x7fß-öø-ÿ]*")
LATIN_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^ a-z0-9ß-öø-ÿ]+")
#: Words kept with their ids in a Python worker; beyond that the memory starts afresh.
MOST_WORDS = 300_000
#: Words of more characters are merged apart, since a round over all symbols for each of their merges grows with the square.
LONG_WORD = 2_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary: encode texts to ids, decode ids to text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            read = json.load(file)
        vocab, merges, end = read["model"]["vocab"], read["model"]["merges"], read["model"]["end_of_word_suffix"] or ""
        self.size = 1 + max(chain(vocab.values(), (x["id"] for x in read["added_tokens"])))
        self.special = {x["content"]: x["id"] for x in read["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = np.full(self.size, "", object)
        for token, k in chain(vocab.items(), self.special.items()):
            self.tokens[k] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[x] for x in symbols])
        self.last = np.array([vocab[x + end] for x in symbols])
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs])
        to = np.array([vocab[a.removesuffix(end) + b if end and a.endswith(end) else a + b] for a, b in pairs])
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.to = keys[order], order, to[order]
        self.known: dict[str, list[int]] = {}

    def merge_long(self, word: str) -> list[int]:
        """Ids of one long word. A round looks only at the places of its pair, kept by rank, and at their new neighbours."""
        flat = np.frombuffer(word.encode("utf-8"), np.uint8)
        symbols = self.inner[flat]
        symbols[-1] = self.last[flat[-1]]
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            """Files the pairs that begin at ``at`` under their ranks."""
            at = at[after[at] < n]
            keys = symbols[at] * self.size + symbols[after[at]]
            spot = np.searchsorted(self.keys, keys)
            spot[spot == len(self.keys)] = 0
            found = self.keys[spot] == keys
            at, spot = at[found], spot[found]
            order = np.argsort(spot, kind="stable")
            at, spot = at[order], spot[order]
            begins = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]]) if len(at) else []
            for k, part in zip(spot[begins].tolist(), np.split(at, begins[1:])):
                if k in places:
                    places[k].append(part)
                else:
                    places[k] = [part]
                    heapq.heappush(heap, (int(self.ranks[k]), k))

        note(np.arange(n - 1))
        while heap:
            _, k = heapq.heappop(heap)
            run = np.unique(np.concatenate(places.pop(k)))
            run = run[(symbols[run] >= 0) & (after[run] < n)]
            run = run[symbols[run] * self.size + symbols[after[run]] == self.keys[k]]
            if not len(run):
                continue
            # of pairs that overlap (a run of one symbol), every second from the left
            first = np.r_[True, after[run[:-1]] != run[1:]]
            offset = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
            run = run[offset % 2 == 0]
            gone = after[run]
            symbols[run] = self.to[k]
            symbols[gone] = -1
            after[run] = after[gone]
            inside = after[run] < n
            before[after[run[inside]]] = run[inside]
            left = before[run]
            note(np.unique(np.r_[run, left[left >= 0]]))
        return symbols[symbols >= 0].tolist()

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Long words are merged one by one, all others round by round in one flat array."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if long:
            apart = set(long)
            others = iter(self.merge([w for i, w in enumerate(words) if i not in apart]) if len(long) < len(words) else [])
            return [self.merge_long(w) if i in apart else next(others) for i, w in enumerate(words)]
        raw = [w.encode("utf-8") for w in words]
        lengths = np.array([len(x) for x in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, owner = self.inner[flat], np.repeat(np.arange(len(words)), lengths)
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        done_symbols, done_owner = [], []
        while len(symbols):
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.searchsorted(self.keys, keys)
            at[at == len(self.keys)] = 0
            found = (self.keys[at] == keys) & (owner[:-1] == owner[1:])
            rank = np.where(found, self.ranks[at], len(self.keys))
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(np.r_[rank, len(self.keys)], starts)
            counts = np.diff(np.r_[starts, len(owner)])
            open_word = np.repeat(best < len(self.keys), counts)
            chosen = np.r_[found & (rank == np.repeat(best, counts)[:-1]), False]
            # of pairs that overlap (a run of one symbol), every second from the left
            run = np.flatnonzero(chosen)
            if len(run):
                first = np.r_[True, np.diff(run) > 1]
                offset = np.arange(len(run)) - np.maximum.accumulate(np.where(first, np.arange(len(run)), 0))
                run = run[offset % 2 == 0]
            merged = symbols.copy()
            merged[run] = self.to[at[run]]
            keep = np.ones(len(symbols), bool)
            keep[run + 1] = False
            done = keep & ~open_word
            done_symbols.append(merged[done])
            done_owner.append(owner[done])
            symbols, owner = merged[keep & open_word], owner[keep & open_word]
        ids, of = np.concatenate([*done_symbols, np.empty(0, int)]), np.concatenate([*done_owner, np.empty(0, int)])
        order = np.argsort(of, kind="stable")
        return [x.tolist() for x in np.split(ids[order], np.cumsum(np.bincount(of, minlength=len(words)))[:-1])]

    def split(self, text: str) -> list[str]:
        """The words of one text without special tokens, normalized."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = WHITE.sub(" ", text).replace("Σ", "σ").lower()
        return LATIN_WORDS.findall(text) if LATIN.fullmatch(text) else WORDS.findall(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; strings of special tokens are those tokens."""
        cut = []
        for text in texts:
            parts = self.cut.split(text) if self.cut and "<|" in text else [text]
            cut.append([[part] if i % 2 else self.split(part) for i, part in enumerate(parts)])
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        known = self.known
        new = list({w for parts in cut for words in parts[::2] for w in words if w not in known})
        known.update(zip(new, self.merge(new)) if new else ())
        flat = chain.from_iterable
        found = [
            list(flat(flat([self.special[x] for x in words] for _ in "1") if i % 2 else flat(map(known.__getitem__, words)) for i, words in enumerate(parts)))
            for parts in cut
        ]
        for word in new:
            if len(word) > LONG_WORD:  # such words hardly come again
                del known[word]
        return found

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Tokens joined by spaces, as the library does for files without a decoder."""
        return " ".join(self.tokens[ids].tolist()) if len(ids) else ""


@functools.lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """The vocabulary at a path that every executor has, once in each Python worker."""
    return WordBpe(path)


def encode_texts(docs: DataFrame, path: str, column: str = "text", ids: str = "ids", decoded: str | None = None, most_chars: int = 2_000_000) -> DataFrame:
    """Adds ``ids`` (array of int) and, if ``decoded`` names a column, the text that they decode to.

    Whole texts, null as empty (no ids, empty decoded text); rows keep their order and other columns. An existing column
    of a result's name, whatever its case, is replaced. No shuffle: rows stay in their partitions.
    """

    def run(texts: list[str]) -> tuple[list[list[int]], list[str] | None]:
        bpe = load(path)
        found = bpe.encode(texts)
        return found, [bpe.decode(x) for x in found] if decoded else None

    return encoded(docs, run, column, ids, decoded, most_chars)
