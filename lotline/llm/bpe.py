"""BPE encoding and decoding through a trie of distinct words.

A block's distinct words, in sorted order, are the depth-first order of their
trie.  The state of a trie node is the last token of the encoding of its
prefix and where that token starts; the encoding before the start is the state
of an earlier node, so a prefix that many words share is encoded once.

A token is the last one of a prefix exactly if it is a suffix of it and forms
a *stable* pair with the last token of the rest: merging the symbols of both
gives the two tokens again.  (Merges of a longer text that leave a boundary
alone act on either side as on that side by itself.)  A pair is not stable if
some part at the right edge of the first token and some part at the left edge
of the second have a merge of their own that comes while both still stand.

Works with vocabulary files of the ``tokenizers`` library with a BPE model with
word ends, the NFC, white-space and lower-case normalisers, a pattern split
and byte-level symbols, such as the public file ``word_bpe_49k.json``.
"""
from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.llm.textnum import blocks, release, tidy

#: A worker forgets its strings, pairs or steps when it knows more than this; longer strings are never kept.
KNOWN_STRINGS, KNOWN_PAIRS, KNOWN_LENGTH = 400_000, 200_000, 64
#: Stands for the end of a word among the symbols; no byte has it as its stand-in.
END = "\n"
PIECE_CHARS = 1 << 20


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte: itself, or the next code point from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordBpe:
    """Encoder and decoder of one vocabulary file; keeps what it learnt of words."""

    def __init__(self, spec: dict, known_pairs: int = KNOWN_PAIRS):
        """``known_pairs`` bounds what is kept of pairs, and of steps of the automaton."""
        self.known_pairs = known_pairs
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: k for k, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.names: list[str | None] = [None] * size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.names[i] = token
        self.whole = None not in self.names
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(pattern)
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.symbols = {b: c for b, c in byte_symbols().items() if chr(b) != c}
        self.spelled = {self._symbols_of(t): t for t in self.ids if t != self.end}
        self.heads = {t[:k] for t in self.spelled for k in range(len(t) + 1)}
        self.stops = regex.compile(r"(?<=[^\W_])[.,](?=\s|$)")
        self.separators = regex.compile("[ \t\n\r\x0b\x0c]+")
        self.halves = {a + b: (a, b) for a, b in pairs}
        self.edges: dict[tuple[str, int], list[tuple[str, int]]] = {}
        self.id_bytes = {t: i.to_bytes(4, "little") for t, i in self.ids.items()}
        self.stable: dict[str, dict[str, bool]] = {}
        self.known_stable = 0
        self._forget_steps()
        self.forget()

    @classmethod
    def load(cls, path: str, **options) -> WordBpe:
        with open(path, encoding="utf-8") as f:
            bpe = cls(json.load(f), **options)
        release()  # what the parsed file took
        return bpe

    def _symbols_of(self, token: str) -> str:
        return token.removesuffix(self.end) + END if token.endswith(self.end) else token

    def forget(self) -> None:
        """Of every known string between spaces: its ids as little-endian bytes; long strings."""
        self.known: dict[str, bytes] = {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        self.long: list[str] = []

    def forget_long(self) -> None:
        for x in self.long:
            del self.known[x]
        self.long = []

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The parts at one edge of a token (0 left, 1 right), each with the rank of the merge that takes it up."""
        known = self.edges.get((token, side))
        if known is None:
            known, part, taken = [], token, len(self.ranks)
            while part:
                known.append((part, taken))
                halves = self.halves.get(part)
                taken = self.ranks[halves] if halves else 0
                part = halves[side] if halves else ""
            self.edges[token, side] = known
        return known

    def _fits(self, before: str, token: str) -> bool:
        """Whether a pair of tokens is stable; remembered by the second one."""
        if self.known_stable > self.known_pairs:
            for pairs in self.stable.values():
                pairs.clear()
            self.edges.clear()
            self.known_stable = 0
        fits, left = True, self._edge(token, 0)
        for a, taken_a in self._edge(before, 1):
            for b, taken_b in left:
                rank = self.ranks.get((a, b))
                # of equal merges the leftmost comes first
                if rank is not None and rank < taken_a and rank <= taken_b:
                    fits = False
        self.stable.setdefault(token, {})[before] = fits
        self.known_stable += 1
        return fits

    def _forget_steps(self) -> None:
        """The automaton of all tokens, made as texts need it.

        A state is the longest end of the symbols read that begins a token: a
        dict of the next states by symbol, and under None the tokens that end
        there, the longest first, each with its number of symbols and its
        stable pairs.
        """
        self.states: dict[str, dict] = {}
        self.known_steps = 0
        self.root = self._state("")

    def _state(self, head: str) -> dict:
        state = self.states.get(head)
        if state is None:
            found = []
            for k in range(len(head)):
                token = self.spelled.get(head[k:])
                if token is not None:
                    found.append((len(head) - k, token, self.stable.setdefault(token, {})))
            state = self.states[head] = {None: found, "": head}
        return state

    def _step(self, state: dict, symbol: str) -> dict:
        if self.known_steps > self.known_pairs:
            self._forget_steps()
        head = state[""] + symbol
        while head not in self.heads:
            head = head[1:]
        self.known_steps += 1
        state[symbol] = found = self._state(head)
        return found

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[str]]]:
        """Each distinct word with its tokens, in the depth-first order of the trie.

        A path holds, for every prefix of the word, the automaton's state, the
        last token and where it starts.
        """
        spelled = {w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(self.symbols): w
                   for w in words}
        tokens, starts, states, before = [""], [0], [self.root], ""
        fits_of, step = self._fits, self._step
        for s in sorted(spelled):
            low, high = 0, min(len(s), len(before))
            if before[:4] == s[:4]:
                low = min(4, high)
            while low < high and before[low] == s[low]:  # the depth at which the word leaves the path of the one before
                low += 1
            del tokens[low + 1:], starts[low + 1:], states[low + 1:]
            state, stop = states[low], low
            for c in s[low:] + END:
                state = state.get(c) or step(state, c)
                stop += 1
                for n, token, stable in state[None]:
                    start = stop - n
                    if not start:
                        break
                    last = tokens[start]
                    fits = stable.get(last)
                    if fits or fits is None and fits_of(last, token):
                        break
                else:
                    raise ValueError(f"no token ends {s[:stop]!r}")
                tokens.append(token)
                starts.append(start)
                states.append(state)
            out = [token]
            while start:
                out.append(tokens[start])
                start = starts[start]
            before = s
            # the end of the word is no part of the next one's path
            del tokens[-1], starts[-1], states[-1]
            yield spelled[s], out[::-1]

    def pieces(self, text: str) -> Iterator[str]:
        """The text in pieces cut at spaces, each of bounded length if it has spaces."""
        i = 0
        while i < len(text):
            j = i + PIECE_CHARS
            if j < len(text):
                j = text.find(" ", j)
                j = len(text) if j < 0 else j
            yield text[i:j]
            i = j

    def strings_of(self, piece: str) -> list[str]:
        """What stands between white space; no word, special token or composed letter crosses it.

        Without special tokens, which are told from the text as it is, a piece is
        normalised as a whole, and a full stop or comma that ends a word becomes a
        string of its own (as it is a word of its own): fewer strings differ.
        """
        if "<|" not in piece:
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            piece = self.stops.sub(r" \g<0>", piece.lower())
        if any(c in piece for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for spaces, too
            return [x for x in self.separators.split(piece) if x]
        return piece.split()

    def words_of(self, string: str) -> list[str]:
        """Normalised words of a string; special tokens stay whole."""
        out = []
        for k, part in enumerate(self.cut.split(string) if "<|" in string else [string]):
            if k % 2:
                out.append(part)
            else:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                # a plain word equals no special token: the pattern parts letters from other characters
                out += self.word.findall(part.lower())
        return out

    def learn(self, strings: Iterable[str]) -> None:
        """Remember the encodings of strings; their new words go through the trie together."""
        words, split = set(), {}
        for x in strings:
            if x.isalpha() and x.isascii() and x.islower():
                words.add(x)
            else:
                split[x] = self.words_of(x)
        words.update(*split.values())
        known, ids = self.known, self.id_bytes
        for word, tokens in self.encode_words(words - known.keys()):
            known[word] = b"".join([ids[t] for t in tokens]) if len(tokens) > 1 else ids[tokens[0]]
            if len(word) > KNOWN_LENGTH:
                self.long.append(word)
        for x, ws in split.items():
            if x not in known:  # else a word itself
                known[x] = b"".join([known[w] for w in ws])
                if len(x) > KNOWN_LENGTH:
                    self.long.append(x)

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        out = []
        for piece in self.pieces(text):
            strings = self.strings_of(piece)
            self.learn(set(strings) - self.known.keys())
            out.append(b"".join(map(self.known.__getitem__, strings)))
            self.forget_long()
        return np.frombuffer(b"".join(out), "<i4").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Token strings joined by spaces, as without a decoder in the file; unknown ids are left out."""
        if not isinstance(ids, list):
            ids = list(ids)
        names = self.names
        if self.whole and (not ids or 0 <= min(ids) and max(ids) < len(names)):
            return " ".join(map(names.__getitem__, ids))
        return " ".join(names[i] for i in ids if 0 <= i < len(names) and names[i] is not None)


def _batched(column: pa.Array) -> Iterator[list[str | None]]:
    """The texts in lists of bounded size; a longer text comes alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    for i, j in blocks(off, PIECE_CHARS):
        yield column.slice(i, j - i).to_pylist()


def _encoded(bpe: WordBpe, column: pa.Array, most: int) -> Iterator[np.ndarray]:
    """For each text its ids; beyond ``most`` known strings they are forgotten."""
    def known(lists: list[list[str]]) -> list[bytes]:
        if len(bpe.known) > most:
            bpe.forget()
        bpe.learn(set().union(*lists) - bpe.known.keys())
        out = [b"".join(map(bpe.known.__getitem__, strings)) for strings in lists]
        bpe.forget_long()
        return out

    for texts in _batched(column):
        if len(texts) == 1 and len(texts[0] or "") > PIECE_CHARS:
            each = [b"".join([x for piece in bpe.pieces(texts[0]) for x in known([bpe.strings_of(piece)])])]
        else:
            each = known([bpe.strings_of(t or "") for t in texts])
        for ids in each:
            yield np.frombuffer(ids, "<i4")


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *,
                     known_strings: int = KNOWN_STRINGS, known_pairs: int = KNOWN_PAIRS, decoded: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, input_ids (array of int) and, if asked for, decoded (the text that the ids give).

    Null texts are empty and have no ids; repeated rows and null ids are
    encoded like any other, each by itself; other columns are ignored, whatever
    their names; an empty table gives no rows; texts of any length are encoded
    whole, a piece at a time.  There are no ties.  ``vocabulary`` is the path of
    the file on every executor.
    """
    @tidy
    def run(batches):
        # made for this task alone: its worker goes on to other stages, which need the memory
        bpe = WordBpe.load(vocabulary, known_pairs=known_pairs)
        for batch in batches:
            first, rows, total = 0, [], 0
            for k, ids in enumerate(_encoded(bpe, batch.column(1), known_strings)):
                rows.append(ids)
                total += len(ids)
                if total > PIECE_CHARS or k == batch.num_rows - 1:
                    out = {"id": batch.column(0).slice(first, len(rows)), "input_ids": pa.array(rows, pa.list_(pa.int32()))}
                    if decoded:
                        out["decoded"] = pa.array([bpe.decode(r.tolist()) for r in rows], pa.string())
                    yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))
                    first, rows, total = k + 1, [], 0

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = [texts.schema["id"], T.StructField("input_ids", T.ArrayType(T.IntegerType()))]
    columns += [T.StructField("decoded", T.StringType())] if decoded else []
    return texts.mapInArrow(run, T.StructType(columns)).withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "input_ids") -> DataFrame:
    """One row per row of ``encoded``: id, decoded.

    Null ids of a row are none, a null or unknown id within them is left out;
    repeated rows, null row ids, other columns and empty tables as in
    :func:`encode_documents`.
    """
    @tidy
    def run(batches):
        bpe = WordBpe.load(vocabulary)
        for batch in batches:
            ids = batch.column(1)
            off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            for i, j in blocks(off.astype(np.int64), PIECE_CHARS):
                texts = [bpe.decode([x for x in row or () if x is not None]) for row in ids.slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(texts, pa.string())], names=["id", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("decoded", T.StringType())])).withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256.

    The digests are of the decimal ids, joined by spaces, and of the text that
    these ids decode to.  Cases as in :func:`encode_documents`.
    """
    return encode_documents(docs, vocabulary, id_col, text_col, decoded=True).select(
        id_col, F.size("input_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("input_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
