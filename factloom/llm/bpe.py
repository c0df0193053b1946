"""BPE encoding and decoding by prefix-sharing trie traversal.

The distinct words of a batch go into a trie over base symbols. A node is a word
prefix; its state is the last token of the prefix's encoding. One token of
the vocabulary, at most as long as the prefix, ends the encoding of a prefix: the
one that the merge rules keep next to the last token of the rest. So a
depth-first walk finds the state of each node from the states above it, and
what words share at their beginnings is encoded once. A word's last symbol carries
the end-of-word mark, which makes it a different base symbol, hence a leaf
of its own. Reading states backwards from a leaf gives the word's tokens.

The library is used for what comes before words: its normaliser and
pre-tokeniser on texts with unusual characters. Texts made of ordinary
characters take an equivalent path through one regular expression.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

#: Words whose encodings a worker keeps: two generations of this many, about 70 MB; three times as many
#: token pairs are remembered. A word is kept from the second time on that it is met; SEEN marks, by
#: hash, tell which have been met.
CACHE_WORDS = 100_000
#: The same where encoding has the executors to itself.
ALONE_CACHE_WORDS = 300_000
SEEN = 1 << 22
#: Characters of one text, and of several, that are encoded at once.
PIECE = 1 << 20
GROUP = 1 << 21

#: Characters for which lower() and the classes below do what the library does: ASCII
#: without odd controls, Latin-1 letters, common dashes, quotes and the euro sign.
ORDINARY = re.compile("[\t\n\r -~À-ÖØ-öø-ÿ‐-―‘-‟…€]*")
LETTERS = "a-zß-öø-ÿ"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\\s{LETTERS}0-9]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary:
    itself if printable in Latin-1, else the next free one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


BYTES = byte_symbols()
END = "</w>"


class Vocabulary:
    """Merge rules as splits: which two tokens make a token, and at what rank."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ids: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.ids.items()}
        self.merges: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[a, b] = rank
            self.parts.setdefault(a + b, (a, b, rank))
        #: Reversed vocabulary: last symbol -> [token or None, the same by the symbol before].
        self.endings: dict[str, list] = {}
        for t in self.ids:
            symbols = [*t.removesuffix(END)] if t != END else [t]
            if t.endswith(END) and t != END:
                symbols[-1] += END
            if len(symbols) > 1 and t not in self.parts:
                continue  # a token counts only if the merge rules build it
            level = self.endings
            for c in reversed(symbols):
                node = level.setdefault(c, [None, {}])
                level = node[1]
            node[0] = t
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._keeps: dict[tuple[str, str], bool] = {}

    def keeps(self, a: str, b: str) -> bool:
        """Whether BPE leaves tokens a and b side by side.

        Undo their latest merges one by one, on whichever side merged later.
        At each step the two tokens that touch must not merge before the pieces that
        were just undone did.
        """
        if (known := self._keeps.get((a, b))) is not None:
            return known
        left, right, limit, ok = a, b, len(self.merges), True
        while ok:
            rank = self.merges.get((left, right))
            # a merge across the border comes first if its rank is less; at equal rank the leftmost pair goes first
            if rank is not None and rank < limit:
                ok = False
                break
            l, r = self.parts.get(left), self.parts.get(right)
            if l is None and r is None:
                break
            # the side whose own merge came later is undone; equal ranks: the left one merged first
            if r is None or (l is not None and l[2] > r[2]):
                left, limit = l[1], l[2]
            else:
                # a border pair of the very rank that made the right token stands further left, so it goes first
                right, limit = r[0], r[2] + 1
        self._keeps[a, b] = ok
        return ok


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v, self.capacity = vocabulary, CACHE_WORDS
        self.young: dict[str, tuple[str, str, int]] = {}
        self.old: dict[str, tuple[str, str, int]] = {}
        self.seen, self.marks = bytearray(SEEN), 0

    def encode_trie(self, words: list[str]) -> dict[str, list[str]]:
        """The tokens of distinct, non-empty words of base symbols."""
        root: dict = {}
        for w in words:
            node = root
            for c in w[:-1]:
                node = node.setdefault(c, {})
            node.setdefault(w[-1] + END, w)
        out: dict[str, list[str]] = {}
        endings, keeps, known = self.v.endings, self.v.keeps, self.v._keeps.get
        prefix: list[str] = []  # base symbols of the path
        last: list[str] = []  # the last token of each prefix of the path
        stack = [(0, c, n) for c, n in root.items()]
        while stack:
            depth, symbol, below = stack.pop()
            del prefix[depth:], last[depth:]
            ending, k, found = endings.get(symbol), 1, []
            while ending is not None:
                if ending[0] is not None:
                    found.append((k, ending[0]))
                if k > depth:
                    break
                ending = ending[1].get(prefix[depth - k])
                k += 1
            for k, token in reversed(found):  # the longest ending first
                if k > depth:
                    break
                pair = (last[depth - k], token)
                ok = known(pair)
                if keeps(*pair) if ok is None else ok:
                    break
            else:
                raise ValueError(f"no token ends {''.join(prefix) + symbol!r}")
            if isinstance(below, str):
                tokens, at = [token], depth - k
                while at >= 0:
                    t = last[at]
                    tokens.append(t)
                    at -= len(t)
                out[below] = tokens[::-1]
                continue
            prefix.append(symbol)
            last.append(token)
            stack.extend((depth + 1, c, n) for c, n in below.items())
        return out

    def learn(self, words: set[str]) -> dict[str, tuple[str, str, int]]:
        """word -> (ids, tokens, number of ids), both joined by spaces. Words
        are texts, or byte symbols after a NUL."""
        young, old, seen, out = self.young, self.old, self.seen, {}
        todo = []
        for w in words:
            if (known := old.get(w)) is not None:
                young[w] = out[w] = known
            else:
                todo.append(w)
        symbols = {w: w[1:] if w[0] == "\0" else w if w.isascii() else "".join([BYTES[b] for b in w.encode("utf-8")]) for w in todo}
        tokens = self.encode_trie(sorted(set(symbols.values())))
        ids = self.v.ids
        for w, s in symbols.items():
            t = tokens[s]
            out[w] = found = (" ".join([str(ids[x]) for x in t]), " ".join(t), len(t))
            at = hash(w) % SEEN
            if seen[at]:
                young[w] = found
            else:
                seen[at] = 1
                self.marks += 1
        return out

    def encoded(self, texts: Iterable[str | None]) -> Iterator[list[list[tuple[str, str, int]]]]:
        """For each text its parts, as cache entries. Texts go through the trie
        together, as many as make a piece."""
        group: list[list] = []
        size = 0
        for text in texts:
            group.append(list(self.parts(text or "")))
            size += len(text or "")
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list]) -> list[list]:
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and many small objects would set off passes over the whole cache
        try:
            return self._looked_up(group)
        finally:
            if collecting:
                gc.enable()

    def _looked_up(self, group: list[list]) -> list[list]:
        get = self.young.get
        out, missing = [], set()
        for parts in group:
            found = [[(str(p[1]), p[0], 1)] if isinstance(p, tuple) else list(map(get, p)) for p in parts]
            for p, f in zip(parts, found, strict=True):
                if None in f:
                    missing.update([w for w, x in zip(p, f, strict=True) if x is None])
            out.append(found)
        if missing:
            new = self.learn(missing)
            out = [[[x or new[w] for w, x in zip(p, f, strict=True)] if None in f else f for p, f in zip(parts, found, strict=True)] for parts, found in zip(group, out, strict=True)]
        self.age()
        return out

    def age(self) -> None:
        if self.marks > SEEN // 2:
            self.seen, self.marks = bytearray(SEEN), 0
        if len(self.v._keeps) > 3 * self.capacity:
            self.v._keeps.clear()
        if len(self.young) > self.capacity:
            self.young, self.old = {}, self.young

    def words(self, text: str) -> list[str]:
        """The words of a text without special tokens, in the form that lookup takes."""
        if ORDINARY.fullmatch(text):
            return WORDS.findall(text.lower())
        normal = self.v.library.normalizer.normalize_str(text)
        return ["\0" + w for w, _ in self.v.library.pre_tokenizer.pre_tokenize_str(normal)]

    def parts(self, text: str) -> Iterator[list[str] | tuple[str, int]]:
        """Lists of words and special tokens, by pieces that end at white space."""
        pieces = self.v.split_special.split(text) if self.v.split_special else [text]
        for k, part in enumerate(pieces):
            if k % 2:
                yield part, self.v.special[part]
                continue
            at = 0
            while at < len(part):
                end = min(len(part), at + PIECE)
                while end < len(part) and part[end] not in " \n\t\r":
                    end += 1
                yield self.words(part[at:end])
                at = end

    def digest(self, texts: Iterable[str | None]) -> list[tuple[int, str, str]]:
        """(n_tokens, ids_sha256, decoded_sha256) of each text."""
        out = []
        for parts in self.encoded(texts):
            n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
            for found in filter(None, parts):
                ids.update((" " * (n > 0) + " ".join([x[0] for x in found])).encode())
                decoded.update((" " * (n > 0) + " ".join([x[1] for x in found])).encode())
                n += sum([x[2] for x in found])
            out.append((n, ids.hexdigest(), decoded.hexdigest()))
        return out

    def encode(self, text: str | None) -> list[int]:
        (parts,) = self.encoded([text])
        return [int(i) for found in parts for x in found for i in x[0].split(" ")]

    def decode(self, ids: list[int]) -> str:
        names, special = self.v.names, {i: t for t, i in self.v.special.items()}
        return " ".join([names[i] if i in names else special[i] for i in ids])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    _ENCODERS[path].capacity = cache_words
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row's whole text; null texts are empty."""
    path = path or default_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids = [e.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([e.decode(x) for x in ids])], names=["id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row; a null or blank text has no tokens.
    ``cache_words`` trades a worker's memory for time and changes no result."""
    path = path or default_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, cache_words)
        for b in batches:
            n, ids, decoded = zip(*e.digest(t.as_py() for t in b.column(1)), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def packed(docs: DataFrame, width: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS) -> DataFrame:
    """(id, ids binary: little-endian unsigned ids of ``width`` bytes) of every row's whole text; a null or blank text has no ids."""
    path = path or default_path()
    kind_of_id, most = f"<u{width}", (1 << 8 * width) - 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        e = encoder(path, cache_words)
        if max(max(e.v.ids.values()), max(e.v.special.values(), default=0)) > most:
            raise ValueError(f"ids of {path} don't fit {width} bytes")
        for b in batches:
            ids = []
            for parts in e.encoded(t.as_py() for t in b.column(1)):
                found = " ".join([x[0] for p in parts for x in p])
                ids.append(np.fromstring(found, np.int64, sep=" ").astype(kind_of_id).tobytes() if found else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids[: b.num_rows], pa.binary())], names=["id", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(each, f"id {kind}, ids binary")


def op7(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), cache_words=ALONE_CACHE_WORDS).withColumnRenamed("id", "doc_id")
