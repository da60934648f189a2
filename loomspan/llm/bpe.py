"""BPE encoding and decoding by forced-boundary splitting.

A merge can only join two symbols if some vocabulary token holds them side by side. Where a text has two neighbours
that no token holds - white space on either side, two pre-tokens, or a byte pair that no token contains - nothing ever
merges across, so it is a certain cut. Fragments between cuts are encoded on their own and the ids are concatenated.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE

from loomspan.llm.common import labelled, read

VOCABULARY = "word_bpe_49k.json"
#: Entries of a worker's table of pre-tokens before it starts anew.
REMEMBERED = 300_000


class FragmentEncoder:
    """Encodes as the tokenizers library does with a word-end BPE file, no special tokens added.

    The library's own normalizer and pre-tokenizer run where a text has a character from U+0300 on; below that,
    lower-casing by Python and the file's pattern give the same pieces.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab, merges = model["vocab"], [tuple(m) for m in model["merges"]]
        self.last = BPE(vocab, merges, end_of_word_suffix=self.end)
        self.inner = BPE(vocab, merges)
        self.tokenizer = Tokenizer.from_file(path)
        self.pairs = {t[i : i + 2] for t in (v.removesuffix(self.end) for v in vocab) for i in range(len(t) - 1)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in self.specials) + ")")
        self.piece = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.wide = regex.compile("[̀-\U0010ffff]")
        self.names = {i: t for t, i in (vocab | self.specials).items()}
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.known: dict[str, tuple[str, str]] = {}
        self.pieces: dict[str, tuple[str, str]] = {}

    def fragments(self, piece: str) -> list[str]:
        """A pre-token in the byte alphabet, cut wherever no vocabulary token holds the pair."""
        out, begin = [], 0
        for i in range(1, len(piece)):
            if piece[i - 1 : i + 1] not in self.pairs:
                out.append(piece[begin:i])
                begin = i
        return [*out, piece[begin:]]

    def encoded(self, piece: str) -> list[int]:
        *head, tail = self.fragments(piece)
        return [t.id for f in head for t in self.inner.tokenize(f)] + [t.id for t in self.last.tokenize(tail)]

    def remember(self, table: dict, word: str, piece: str) -> tuple[str, str]:
        """The ids of a pre-token as text, and its decoded form."""
        ids = self.encoded(piece)
        if len(table) >= REMEMBERED:
            table.clear()
        out = table[word] = (" ".join(map(str, ids)), " ".join([self.names[i] for i in ids]))
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """(ids as decimal text joined by blanks, decoded text) of a whole text."""
        ids: list[str] = []
        names: list[str] = []
        for part in self.special.split(text) if "<|" in text else (text,):
            if part in self.specials:
                ids.append(str(self.specials[part]))
                names.append(part)
                continue
            if self.wide.search(part):
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(part)):
                    a, b = self.pieces.get(piece) or self.remember(self.pieces, piece, piece)
                    ids.append(a)
                    names.append(b)
                continue
            known = self.known
            for word in self.piece.findall(part.lower()):
                a, b = known.get(word) or self.remember(known, word, "".join([self.byte[x] for x in word.encode()]))
                ids.append(a)
                names.append(b)
        return " ".join(ids), " ".join(names)


@lru_cache(maxsize=2)
def encoder(name: str) -> FragmentEncoder:
    import public_tokenizers

    return FragmentEncoder(name if "/" in name else public_tokenizers.path(name))


def encode(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, output: str = "digest") -> DataFrame:
    """docs plus n_tokens and, by `output`, digests (ids_sha256, decoded_sha256) or the values (ids, decoded).

    vocabulary: a name of public_tokenizers or a path that every executor can open. A null text counts as empty: no
    tokens, an empty decoded text. Columns of the new names, in any case, are replaced, others passed through, whatever their names. Texts of any length are
    read whole, rows that repeat get equal results, an empty table gives an empty table.
    """
    values = output == "values"
    kinds = [("n_tokens", T.LongType()), *([("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())] if values else [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])]

    def run(texts: pa.Array) -> list[pa.Array]:
        own = encoder(vocabulary)
        out = [own.encode(t or "") for t in texts.to_pylist()]
        counts = pa.array([ids.count(" ") + 1 if ids else 0 for ids, _ in out], pa.int64())
        if values:
            return [counts, pa.array([[int(x) for x in ids.split()] for ids, _ in out], pa.list_(pa.int32())), pa.array([d for _, d in out], pa.string())]
        return [counts, *(pa.array([hashlib.sha256(x[k].encode()).hexdigest() for x in out], pa.string()) for k in (0, 1))]

    return labelled(docs, text_col, kinds, run)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; nulls, empty and very long texts, ties, repeats, empty tables and other columns as in encode."""
    return encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


QUERIES = {"op4_bpe_roundtrip": op4_bpe_roundtrip}
ORACLE: dict[str, str] = {}
