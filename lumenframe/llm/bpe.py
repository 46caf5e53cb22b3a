"""BPE encoding and decoding: speculate and verify.

For every new word the longest tokens from the left are proposed. A word's proposal is its BPE encoding exactly
if each adjacent pair of tokens is compatible, that is if merging the pair's own symbols gives the pair back; all
pairs of a batch's new words are tested at once against a sorted table of pairs, which grows by the pairs not met
before. Only words with an incompatible pair are merged exactly, by rank. A Python worker caches words in two
generations of `MOST_WORDS` each: when the younger is full it becomes the older, whose words return as they are met.
The table of pairs starts anew beyond `MOST_PAIRS`.

Texts are normalised and split as the vocabulary file's pipeline says: special tokens are found in the raw text,
then NFC and lower case, then contractions, runs of letters, single digits and runs of other characters, white space
dropped; tokens then stand for the words' UTF-8 bytes, the last with `</w>`. The file names no decoder, so decoding
joins tokens by blanks.

Null and empty texts have no tokens and decode to an empty string. Whole texts are encoded, whatever their length.
Repeated rows are encoded alike; an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "word_bpe_49k.json"
END = "</w>"
MOST_WORDS, MOST_PAIRS = 150_000, 2_000_000
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: All code points before U+0378 are assigned.
LATER = re.compile("[^\\x00-\\u0377]")
ANY_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The letter for each byte: printable ones stand for themselves, the others for code points from 256 up."""
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def unassigned() -> re.Pattern:
    """Any code point that Python's character tables lack. The tokenizers library's tables may be newer and know its class."""
    spans, first = [], None
    for c in range(sys.maxunicode + 2):
        if c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn":
            first = c if first is None else first
        elif first is not None:
            spans.append(f"\\U{first:08x}-\\U{c - 1:08x}")
            first = None
    return re.compile(f"[{''.join(spans)}]")


class Codec:
    def __init__(self, path: str):
        self.path, self.unsure, self.library = path, unassigned(), None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for text, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = text
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {(self.ids[a], self.ids[b]): k for k, (a, b) in enumerate(merges)}
        self.made = [self.ids[a + b] for a, b in merges]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = {b: x for b, x in enumerate(byte_letters())}
        self.longest = max(map(len, self.ids))
        self.words: dict[str, bytes] = {x: np.array([i], "<u4").tobytes() for x, i in self.special.items()}
        self.older: dict[str, bytes] = {}
        self.pairs, self.fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.exact_words = self.all_words = 0

    def pieces(self, text: str) -> list[str]:
        """The words of a text, and special tokens as they are."""
        if self.split_special and "<|" in text:
            out = []
            for k, part in enumerate(self.split_special.split(text)):
                out += [part] if k % 2 else self._pieces(part)
            return out
        return self._pieces(text)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORD.findall(text.lower())
        if LATER.search(text) and self.unsure.search(text):
            return self._library_pieces(text)
        # Lower case goes character by character: no final sigma.
        return ANY_WORD.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _library_pieces(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.bytes = {x: b for b, x in self.letters.items()}
        words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.bytes.__getitem__, w)).decode() for w, _ in words]

    def symbols(self, token: str) -> list[int]:
        body, end = (token[: -len(END)], END) if token.endswith(END) and len(token) > len(END) else (token, "")
        return [self.ids[c] for c in body[:-1]] + [self.ids[body[-1] + end]]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact BPE: the pair of least rank first, the leftmost of equal ones."""
        never, get, made = len(self.made), self.ranks.get, self.made
        rank = [get(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while rank:
            best = min(rank)
            if best == never:
                break
            at = rank.index(best)
            parts[at : at + 2] = [made[best]]
            del rank[at]
            if at:
                rank[at - 1] = get((parts[at - 1], parts[at]), never)
            if at < len(rank):
                rank[at] = get((parts[at], parts[at + 1]), never)
        return parts

    def propose(self, letters: str) -> list[int]:
        ids, n, at, out = self.ids, len(letters), 0, []
        while True:
            whole = ids.get(letters[at:] + END)
            if whole is not None:
                out.append(whole)
                return out
            end = min(n - 1, at + self.longest)
            while (t := ids.get(letters[at:end])) is None:
                end -= 1
            out.append(t)
            at = end

    def learn_pairs(self, keys: np.ndarray) -> np.ndarray:
        """Whether each pair (left * size + right) is compatible; pairs not met before are merged and remembered."""
        size = len(self.tokens)
        distinct, where = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pairs, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.pairs)
        known[inside] = self.pairs[at[inside]] == distinct[inside]
        fits = np.zeros(len(distinct), bool)
        fits[known] = self.fits[at[known]]
        new = np.flatnonzero(~known)
        for i in new:
            a, b = divmod(int(distinct[i]), size)
            fits[i] = self.merge(self.symbols(self.tokens[a]) + self.symbols(self.tokens[b])) == [a, b]
        if len(new):
            pairs = np.concatenate([self.pairs, distinct[new]])
            order = np.argsort(pairs, kind="stable")
            self.pairs, self.fits = pairs[order], np.concatenate([self.fits, fits[new]])[order]
        return fits[where]

    def learn_words(self, new: list[str]) -> None:
        letters = [w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self.letters) for w in new]
        proposed = [self.propose(x) for x in letters]
        size = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(size.sum()))
        starts = np.cumsum(size) - size
        inner = np.ones(len(flat), bool)
        inner[starts] = False  # each token but a word's first ends a pair
        right = np.flatnonzero(inner)
        bad = np.zeros(len(flat), bool)
        bad[right] = ~self.learn_pairs(flat[right - 1] * len(self.tokens) + flat[right])
        failed = np.logical_or.reduceat(bad, starts) if len(flat) else np.zeros(0, bool)
        data = flat.astype("<u4").tobytes()
        for k, w in enumerate(new):
            if failed[k]:
                parts = [self.ids[c] for c in letters[k][:-1]] + [self.ids[letters[k][-1] + END]]
                self.words[w] = np.array(self.merge(parts), "<u4").tobytes()
            else:
                self.words[w] = data[4 * starts[k] : 4 * (starts[k] + size[k])]
        self.exact_words += int(failed.sum())
        self.all_words += len(new)

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs, self.fits = self.pairs[:0], self.fits[:0]
        out = []
        for first in range(0, len(texts), 256):
            if len(self.words) > MOST_WORDS:
                self.older, self.words = self.words, {x: self.words[x] for x in self.special}
            pieces = [self.pieces(t) for t in texts[first : first + 256]]
            new = set().union(*map(set, pieces)).difference(self.words)
            met = new.intersection(self.older)
            self.words.update((w, self.older[w]) for w in met)
            new -= met
            if new:
                self.learn_words(list(new))
            get = self.words.__getitem__
            out += [b"".join(map(get, p)) for p in pieces]
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}


def codec(vocabulary: str = VOCABULARY) -> Codec:
    """The codec of a vocabulary file (a path, or the name of a public tokenizer), loaded once a Python worker."""
    if vocabulary not in _CODECS:
        path = vocabulary
        if "/" not in vocabulary:
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _CODECS[vocabulary] = Codec(str(path))
    return _CODECS[vocabulary]


def _coder(vocabulary: str, rows: int, decoded: bool):
    def run(batches):
        c = codec(vocabulary)
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                at = batch.schema.get_field_index("text")
                ids = c.encode_batch([t or "" for t in batch.column(at).to_pylist()])
                cols = [batch.column(i) for i in range(batch.num_columns)]
                names = [*batch.schema.names, "__ids", "__decoded"]
                text = pa.array([c.decode(x) if decoded else None for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(ids, pa.binary()), text], names)

    return run


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, decoded: bool = True, rows: int = 1000) -> DataFrame:
    """docs in their own columns, with __ids (little-endian unsigned 32-bit integers) and __decoded."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(_coder(vocabulary, rows, decoded), f"{schema}, __ids binary, __decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("__ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("__decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
