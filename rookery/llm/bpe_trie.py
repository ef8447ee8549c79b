"""BPE encoding and decoding by prefix-sharing trie traversal.

Of the texts of a slice of rows, the distinct words that are not yet known are put in a trie of symbols (bytes; a word's
last one carries the end-of-word mark). A depth-first traversal gives every node the last token of the encoding of its
path: the one token that ends there, fits on the path before it (whose state is known), and makes a pair that BPE would
not have merged otherwise. Which tokens end at a node is the other state that goes down the trie: the place in an
automaton of all tokens. The trie is kept as the sorted words: their order is the depth-first order, and the states of
the path shared with the previous word stay on a stack, so what words share is computed once. A word's ids follow by
walking back from its leaf.

The vocabulary is read from a tokenizer file (JSON) whose ids are in merge order; its path is a parameter, and the
executors need not see the file. Special tokens in a text become their ids, as in the file's own library.

Defined cases: a null text counts as empty and has no ids. Texts of any length are encoded whole. The word memory of a
task is bounded (twice ``MEMORY`` words: what was not used for long is forgotten), which changes no result. Only the
named columns are used.
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

from ._shared import slices

#: White space in the sense of Unicode. Python's own notion adds the four separators U+001C to U+001F.
WHITE = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
SEPARATORS = "".join(map(chr, range(0x1C, 0x20)))
MEMORY = 100_000
PAIRS = 200_000
SLICE, SLICE_BYTES = 256, 1 << 20


def load_vocabulary(path: str) -> dict:
    """What the tasks need of a tokenizer file: pieces by id, merges in order, special tokens, word split."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model = file["model"]
    ids = model["vocab"]
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    pieces = [""] * (max(*ids.values(), *special.values()) + 1)
    for piece, i in [*ids.items(), *special.items()]:
        pieces[i] = piece
    split = next(p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"pieces": pieces, "merges": [(ids[a], ids[b], ids[a + b]) for a, b in merges], "special": special, "split": split, "end": model["end_of_word_suffix"]}


def byte_alphabet() -> list[str]:
    """The printable character for each byte: itself where printable, else the next from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class TokenAutomaton:
    """Which tokens end at a place: one state per beginning of a token, with links to the longest shorter one."""

    def __init__(self, tokens: list[tuple[bytes, int, bool]]):
        self.goto: dict[int, int] = {}  # state and next byte
        self.fail, self.depth = [0], [0]
        ends: list[dict[bool, int]] = [{}]
        for piece, i, marked in tokens:
            at = 0
            for byte in piece:
                key = at << 8 | byte
                at = self.goto.get(key, 0)
                if not at:
                    at = self.goto[key] = len(self.fail)
                    self.fail.append(0)
                    self.depth.append(0)
                    ends.append({})
            ends[at][marked] = i
        # tokens (length, id), longest first, that end at a state: without and with the end-of-word mark
        self.inner: list[tuple] = [()] * len(self.fail)
        self.final: list[tuple] = [()] * len(self.fail)
        after: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.goto.items():
            after.setdefault(key >> 8, []).append((key & 255, to))
        todo = [0]
        for at in todo:  # breadth first: links go to states that are done
            for byte, to in after.get(at, ()):
                self.depth[to], back = self.depth[at] + 1, 0
                if at:
                    back = self.fail[at]
                    while back and back << 8 | byte not in self.goto:
                        back = self.fail[back]
                    back = self.goto.get(back << 8 | byte, 0)
                self.fail[to] = back
                for out, marked in ((self.inner, False), (self.final, True)):
                    own = ((self.depth[to], ends[to][marked]),) if marked in ends[to] else ()
                    out[to] = own + out[back] if own else out[back]
                todo.append(to)


class TrieEncoder:
    def __init__(self, vocabulary: dict, specials: bool = True):
        self.pieces = vocabulary["pieces"]
        end = vocabulary["end"]
        self.special = vocabulary["special"] if specials else {}
        self.merged = {a << 20 | b: c for a, b, c in vocabulary["merges"]}
        self.left = list(range(len(self.pieces)))
        self.right = list(self.left)
        for a, b, c in vocabulary["merges"]:
            self.left[c], self.right[c] = a, b
        byte, outside = {c: k for k, c in enumerate(byte_alphabet())}, set(vocabulary["special"].values())
        tokens = [(bytes(map(byte.__getitem__, p.removesuffix(end))), i, p.endswith(end)) for i, p in enumerate(self.pieces) if i not in outside]
        self.length = [0] * len(self.pieces)
        for piece, i, _ in tokens:
            self.length[i] = len(piece)
        self.tokens = TokenAutomaton(tokens)
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.pieces))]
        self.strings = pa.array(self.pieces, pa.string())
        self.white = regex.compile(f"[{regex.escape(WHITE)}]+")
        self.words = regex.compile(vocabulary["split"].replace(r"[^\s\p{L}\p{N}]+", rf"[^{regex.escape(WHITE)}\p{{L}}\p{{N}}]+")).findall
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.pairs: dict[int, bool] = {}
        self.known: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}

    def _apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a, b side by side: no merge across their border comes before they are made."""
        x, y, below, out = a, b, len(self.pieces), None
        while out is None:
            made = self.merged.get(x << 20 | y)
            if made is not None and made < below:
                out = False
            elif x > y:
                below, x = x, self.right[x]
                if x == below:
                    below, y0 = y + 1, y
                    y = self.left[y]
                    out = True if y == y0 else None
            else:
                below, y0 = y + 1, y
                y = self.left[y]
                if y == y0:
                    below, x0 = x, x
                    x = self.right[x]
                    out = True if x == x0 else None
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        self.pairs[a << 20 | b] = out
        return out

    def traverse(self, words: Iterable[str]) -> dict[str, bytes]:
        """The packed ids of each word, by one traversal of the trie of all of them."""
        out: dict[str, bytes] = {}
        goto, fail, inner, final = self.tokens.goto, self.tokens.fail, self.tokens.inner, self.tokens.final
        get, length, packed, kept, apart = goto.get, self.length, self.packed, self.pairs, self._apart
        states, nodes, before = [0], [0], b""
        for path, word in sorted((w.encode(), w) for w in words):
            n, shared = len(path), 0
            top = min(len(states) - 1, n - 1)
            while shared < top and path[shared] == before[shared]:
                shared += 1
            del states[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for k in range(shared, n):
                byte = path[k]
                to = get(node << 8 | byte)
                while to is None:
                    node = fail[node]
                    to = get(node << 8 | byte)
                node = to
                k += 1
                # the last token is the longest that ends here and stays apart from the last token before it
                for size, token in inner[node] if k < n else final[node]:
                    if size == k:
                        break
                    pair = states[k - size] << 20 | token
                    if kept[pair] if pair in kept else apart(pair >> 20, token):
                        break
                else:
                    raise ValueError(f"no token for {path[:k]!r}")
                if k < n:
                    nodes.append(node)
                    states.append(token)
            ids, at = [packed[token]], n - length[token]
            while at:
                token = states[at]
                ids.append(packed[token])
                at -= length[token]
            out[word] = b"".join(ids[::-1])
            before = path
        return out

    def learn(self, stretches: Iterable[str]) -> None:
        """Keeps the packed ids of stretches without white space, each of which has some words."""
        split = {}
        for s in stretches:
            if s.isascii():
                t = s.lower()
                split[s] = (t,) if t.isalpha() else self.words(t)
            else:
                split[s] = self.words(unicodedata.normalize("NFC", s).replace("\u03a3", "\u03c3").lower())
        ids = self.traverse({w for ws in split.values() for w in ws})
        for s, ws in split.items():
            self.known[s] = ids[ws[0]] if len(ws) == 1 else b"".join(map(ids.__getitem__, ws))

    def _stretches(self, text: str) -> list[str]:
        return self.white.split(text) if any(c in text for c in SEPARATORS) else text.split()

    def _parts(self, text: str) -> list[str | int]:
        """Stretches without white space, and ids of special tokens between them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._stretches(text)
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            out += [*self._stretches(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self._stretches(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids (little-endian unsigned 32-bit numbers) of each text."""
        parts = [self._parts(t) for t in texts]
        wanted = set().union(*parts)
        fresh = wanted.difference(self.known)
        if len(self.known) + len(fresh) > MEMORY:
            self.older, self.known, fresh = self.known, {}, wanted
        older, known = self.older, self.known
        known.update((s, older[s]) for s in fresh if s in older)
        known.update((i, self.packed[i]) for i in self.special.values())
        self.learn(s for s in fresh if s not in known)
        return [b"".join(map(known.__getitem__, p)) for p in parts]

    def decode(self, ids: list[bytes | None]) -> pa.Array:
        """The texts of packed ids: pieces with a space between them, as the file names no decoder."""
        ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)])
        pieces = self.strings.take(pa.array(np.frombuffer(b"".join(x or b"" for x in ids), "<u4")))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)
        return pc.if_else(pa.array([x is not None for x in ids], pa.bool_()), pc.binary_join(lists, " "), None)


def _coder(vocabulary: dict, specials: bool = True) -> TrieEncoder:
    """The coder of a worker, kept with the broadcast vocabulary for the tasks to come."""
    if specials not in (kept := vocabulary.setdefault("coders", {})):
        kept[specials] = TrieEncoder(vocabulary, specials)
    return kept[specials]


def encode(docs: DataFrame, tokenizer: str, *, decode: bool = False, specials: bool = True) -> DataFrame:
    """doc_id, n_tokens and ``ids`` (packed: little-endian unsigned 32-bit numbers), and ``decoded`` if asked for."""
    packed = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))  # one tokenizer file
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids", "binary")
    if decode:
        schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed.value, specials)
        for part in slices(batches, 1, SLICE, SLICE_BYTES):
            ids = coder.encode([t or "" for t in part.column(1).to_pylist()])
            columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                columns.append(coder.decode(ids))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``decoded`` text of each row of (doc_id, ids)."""
    packed = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))
    schema = encoded.select("doc_id").schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(packed.value)
        for part in slices(batches, 1, SLICE, SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), coder.decode(part.column(1).to_pylist())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)
