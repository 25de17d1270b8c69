"""Byte-level BPE encoding and decoding over a pair occurrence index.

All distinct pre-tokens that a batch brings are laid out in one symbol array. An index maps each pair
(by its rank) to all its positions; active ranks are taken in ascending order, every occurrence of the
pair is merged at once, and the lists of the pairs next to it are updated. A merged pair can only form
pairs of a higher rank, so ascending ranks give each pre-token the library's merges.

Null texts count as empty: no ids, empty decoded text. Added tokens inside a text get their own id, as
the library's default has it. Ill-formed byte sequences, which single pre-tokens may decode to, are
replaced only once the whole text is joined.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintlake.llm.common import REMEMBERED, bounded_batches, release, table

#: Distinct pre-tokens that a worker remembers, some 320 bytes each; beyond it only those of the texts at hand stay, with the same results.
MEMORY = 200_000
#: Characters of text whose pre-tokens share one index.
CHUNK = 4_000_000
_WHITE = r"\t-\r\x20\x85\xa0  -     　"
#: Fixed pattern of the pre-tokeniser; white space is spelt out since engines differ on control characters.
PRETOKEN = rf" ?\p{{L}}++| ?\p{{N}}++|'(?:[stmd]|re|ve|ll)| ?[^{_WHITE}\p{{L}}\p{{N}}]++|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def distinct(a: np.ndarray) -> np.ndarray:
    """Sorted distinct values (a sort is quicker here than numpy's hashing)."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in t) for t, i in vocab.items() if all(c in alphabet for c in t)}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.of_byte = np.full(256, -1, dtype=np.int32)
        for i, b in self.bytes_of.items():
            if len(b) == 1 and i not in self.added.values():
                self.of_byte[b[0]] = i
        self.size = max(self.bytes_of) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.name = [str(i) for i in range(self.size)]
        self.find = regex.compile(PRETOKEN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.known: dict[str, tuple[str, int, bytes]] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it never merges."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and the n+1 cuts between them."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        sym = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        n = len(sym)
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[cuts[1:][sizes > 0] - 1] = -1
        before[cuts[:-1][sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """List the pairs that start at these positions under their ranks."""
            r = self.ranks(sym[at], sym[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            o = np.argsort(r, kind="stable")
            at, r = at[o], r[o]
            edge = np.flatnonzero(np.diff(r)) + 1
            for rank, group in zip(r[np.concatenate([[0], edge])].tolist(), np.split(at, edge), strict=True):
                if rank not in index:
                    heapq.heappush(active, rank)
                index[rank].append(group)

        enter(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else distinct(np.concatenate(lists))
            a, b, new = int(self.left[rank]), int(self.right[rank]), int(self.made[rank])
            nxt = after[at]
            ok = (sym[at] == a) & (nxt >= 0)
            ok[ok] &= sym[nxt[ok]] == b
            at, nxt = at[ok], nxt[ok]
            if a == b and len(at) > 1:  # pairs may overlap: of a run take every second, from the left
                taken, last = [], -1
                for p, q in zip(at.tolist(), nxt.tolist(), strict=True):
                    if p != last:
                        taken.append((p, q))
                        last = q
                at, nxt = (np.array(x, dtype=np.int32) for x in zip(*taken, strict=True))
            if not len(at):
                continue
            beyond = after[nxt]
            sym[at], sym[nxt] = new, -1
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            prior = before[at]
            enter(distinct(np.concatenate([prior[prior >= 0], at[has]])))
        alive = sym >= 0
        return sym[alive], np.concatenate([[0], np.cumsum(alive)])[cuts]

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not known yet, over one index."""
        new = sorted(words)
        ids, cuts = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
        ids, cuts, name, made = ids.tolist(), cuts.tolist(), self.name, self.bytes_of
        for k, w in enumerate(new):
            own = ids[cuts[k] : cuts[k + 1]]
            self.known[w] = (",".join([name[i] for i in own]), len(own), b"".join([made[i] for i in own]))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, int, bytes]]:
        """For each text its ids joined by commas, their number and the bytes that they decode to."""
        parts: list[list] = []
        words: dict[str, str] = {}
        for t in texts:
            row: list = []
            for k, s in enumerate(self.split(t or "") if self.split else [t or ""]):
                # a word is held once, however often it comes
                row.append(self.added[s] if k % 2 else [words.setdefault(w, w) for w in self.find(s)])
            parts.append(row)
        known = self.known
        new = words.keys() - known.keys()
        if len(known) + len(new) > MEMORY:
            self.known = known = {w: known[w] for w in words.keys() - new}
        if new:
            self.learn(new)
        for row in parts:
            got = []
            for x in row:
                if isinstance(x, int):
                    got.append((self.name[x], 1, self.bytes_of[x]))
                else:
                    got.extend(map(known.__getitem__, x))
            names, sizes, decoded = zip(*got, strict=True) if got else ((), (), ())
            yield ",".join(names), sum(sizes), b"".join(decoded)


_workers: dict[str, Bpe] = {}
REMEMBERED.append(_workers)


def _bpe(path: str) -> Bpe:
    if path not in _workers:
        _workers[path] = Bpe(path)
    return _workers[path]


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[list[str | None]]:
    """Runs of texts of about `limit` characters, one text at least."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """`keep` columns with n_tokens, ids_sha256, decoded_sha256 and, where asked, the ids as an array."""
    bounded_batches(docs.sparkSession)
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(_workers)
        bpe = _bpe(path)
        gc.disable()  # while this task runs: nothing here is cyclic, and the collector would walk all remembered words
        try:
            for b in batches:
                count, of_ids, of_text, arrays = [], [], [], []
                for part in chunks(b.column(b.num_columns - 1).to_pylist()):
                    for names, n, raw in bpe.encode(part):
                        count.append(n)
                        of_ids.append(hashlib.sha256(names.encode()).hexdigest())
                        of_text.append(hashlib.sha256(raw.decode("utf-8", "replace").encode()).hexdigest())
                        if ids:
                            arrays.append(np.array(names.split(",") if n else [], dtype=np.int32))
                more = [pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
                if ids:
                    more.append(pa.array(arrays, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=schema.names)
        finally:
            gc.enable()

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of `df` with the text that its array of ids decodes to (null: null)."""
    schema = T.StructType([*df.schema.fields, *([] if out in df.columns else [T.StructField(out, T.StringType())])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _bpe(path).bytes_of
        for b in batches:
            texts = [None if x is None else b"".join([made.get(i, b"") for i in x]).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            cols = {f: b.column(f) for f in b.schema.names} | {out: pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([cols[f] for f in schema.names], names=schema.names)

    return df.mapInArrow(run, schema)


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with byte_bpe_50k.json and decoded again."""
    import public_tokenizers

    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)
