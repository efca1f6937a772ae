"""BPE encoding by prefix-sharing trie traversal, and decoding.

The encoding of a prefix is the encoding of a shorter prefix and one last token, so a state of one
number, the last token, is enough for each trie node. Words in sorted order are the trie in
depth-first order: a word starts from the states of the prefix that it shares with the word before.
A token can be last if it is a suffix of the prefix and stays apart from the token before it.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from changelake.llm.common import prepare
from changelake.llm.packing import OTHER, PIECE

# Words that a Python worker remembers between batches (about 150 MB); then it starts anew.
REMEMBERED = 400_000
# Keys of a vocabulary node beside its letters: the token that ends here, within a word or with it.
PLAIN, CLOSING = 0, 1
# White space for Python's split(), but not for the tokenizer.
NOT_SPACE = re.compile("[\x1c-\x1f]")
# Words that the short division of pieces does not know.
ODD_WORD = re.compile(f"{NOT_SPACE.pattern}|{OTHER.pattern}")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = iter(range(256, 512))
    return [chr(b if b in plain else next(shifted)) for b in range(256)]


class TrieEncoder:
    """Encodes words with the vocabulary, merges and patterns of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.normal = Tokenizer.from_file(path).normalizer
        self.letters = byte_letters()
        self.root = self._graft()
        self.apart: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, str, str]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}

    # -- which tokens may follow each other

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix):
            body = token.removesuffix(self.suffix)
            return [*body[:-1], body[-1:] + self.suffix]
        return [*token]

    def _merged(self, symbols: list[str]) -> list[str]:
        """Plain BPE of a short symbol list: always the best-ranked pair, leftmost first."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), i)
                           for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == len(self.ranks):
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2:]]
        return symbols

    def _stay_apart(self, before: int, last: int) -> bool:
        """Whether the two tokens (or the one, if ``before`` is -1) are what BPE makes of their letters."""
        found = self.apart.get((before, last))
        if found is None:
            pair = [self.tokens[x] for x in (before, last) if x >= 0]
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            found = self.apart[before, last] = self._merged([s for t in pair for s in self._symbols(t)]) == pair
        return found

    # -- depth-first traversal

    def _graft(self) -> dict:
        """The vocabulary as a trie of its own: a node has its tokens under ``PLAIN`` and ``CLOSING``."""
        root: dict = {}
        for token, number in self.vocab.items():
            closing = bool(self.suffix) and token.endswith(self.suffix)
            node = root
            for letter in token.removesuffix(self.suffix) if closing else token:
                node = node.setdefault(letter, {})
            node[CLOSING if closing else PLAIN] = number
        return root

    def _last(self, states: list[int], open_tokens: list[tuple[int, dict]], kind: int, end: int) -> tuple[int, int]:
        """(last token, its start) of the encoding of a prefix: the longest that stays apart from what is
        before it. ``open_tokens`` are the tokens that may end here, by their start."""
        for start, node in open_tokens:
            token = node.get(kind)
            if token is not None and self._stay_apart(states[start], token):
                return token, start
        raise ValueError(f"no token ends at {end}")

    def encode_pieces(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct piece (letters standing for bytes).

        The words' trie and the vocabulary's are walked together: a prefix keeps the vocabulary
        nodes of all tokens that are open at its end, and the next letter moves each of them on.
        """
        out: dict[str, tuple[int, ...]] = {}
        states, starts, opened, before = [-1], [0], [[]], ""
        root, final = self.root, CLOSING if self.suffix else PLAIN
        for word in sorted(pieces):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            # States of all proper prefixes; those of the shared prefix are there already.
            shared = min(shared, len(states) - 1)
            del states[shared + 1:], starts[shared + 1:], opened[shared + 1:]
            for end in range(len(states), len(word) + 1):
                letter = word[end - 1]
                here = [(s, m) for s, node in opened[-1] if (m := node.get(letter)) is not None]
                if (m := root.get(letter)) is not None:
                    here.append((end - 1, m))
                if end < len(word):
                    token, start = self._last(states, here, PLAIN, end)
                    states.append(token)
                    starts.append(start)
                    opened.append(here)
            token, at = self._last(states, here, final, len(word))
            ids = [token]
            while at:
                ids.append(states[at])
                at = starts[at]
            out[word] = tuple(reversed(ids))
            before = word
        return out

    # -- texts

    def words(self, text: str) -> list[str]:
        """What white space divides; no piece and no normalisation reaches across it."""
        return text.split() if not NOT_SPACE.search(text) else regex.findall(r"\S+", text)

    def _pieces(self, word: str) -> Iterator[int | str]:
        """Ids of special tokens, and the pieces between them."""
        if not ODD_WORD.search(word):
            yield from [p if p.isascii() and p.isprintable() else "".join([self.letters[b] for b in p.encode()])
                        for p in PIECE.findall(word.lower())]
            return
        for k, part in enumerate(self.cut.split(word) if "<" in word else (word,)):
            if k % 2:
                yield self.special[part]
            elif part:
                plain = part.lower() if part.isascii() else self.normal.normalize_str(part)
                for piece in self.pieces.findall(plain):
                    yield "".join([self.letters[b] for b in piece.encode()])

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of each distinct white-space word. Words share pieces, which are remembered too."""
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        parts = {word: list(self._pieces(word)) for word in words}
        fresh = {p for x in parts.values() for p in x if p not in self.parts and isinstance(p, str)}
        self.parts.update(self.encode_pieces(fresh))
        ids = self.parts
        return {word: ids[x[0]] if len(x) == 1 and isinstance(x[0], str) else tuple(
            i for p in x for i in (ids[p] if isinstance(p, str) else (p,))) for word, x in parts.items()}

    def encode(self, text: str) -> list[int]:
        words = self.words(text)
        ids = self.encode_words(set(words))
        return [i for word in words for i in ids[word]]

    def decode(self, ids: Iterable[int]) -> str:
        """Token texts joined by a space, special tokens too, as a file without decoder says.

        Ids outside the vocabulary are left out.
        """
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@functools.cache
def trie_encoder(path: str) -> TrieEncoder:
    return TrieEncoder(path)


def encode_decode(documents: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text.

    A null text is empty: no tokens, digests of the empty string. Repeated rows give repeated rows;
    other columns are left out. The distinct new words of a batch go into one trie; a worker
    remembers a bounded number of encoded words, which changes speed alone.
    """
    prepare(documents.sparkSession)

    def run(batches):
        encoder = trie_encoder(path)
        known: dict[str, tuple[int, str, str]] = encoder.known
        for batch in batches:
            split = [encoder.words(t or "") for t in batch.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known.clear()
            fresh = set().union(*split).difference(known)
            for word, ids in encoder.encode_words(fresh).items():
                known[word] = (len(ids), " ".join(map(str, ids)), encoder.decode(ids))
            counts, id_digests, text_digests = [], [], []
            for words in split:
                found = [known[w] for w in words]
                counts.append(sum([f[0] for f in found]))
                id_digests.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                text_digests.append(hashlib.sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(text_digests, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
