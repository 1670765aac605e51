"""Alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by a byte-level BPE (A) and by a piece BPE with byte
fallback (B); both see one space before the text.  The tokens of a batch lie
end to end as byte ranges.  ``pandas.merge_asof``, keyed by document, finds
for each token start of one side the token of the other side that covers it;
the union of both directions gives all overlapping pairs.  Pairs that end
together cut the tokens into groups and are the links of the corpus.

Links are counted over the corpus by partial aggregates in the tasks.  The
counts, of which there are never more than pairs of vocabulary entries, come
back to the documents in blocks of bounded size, one block at a time, so
links are never shuffled.

Long texts are encoded in stretches.  They are cut before a single space
between two word characters, where neither tokenizer has a token across: A
splits there before it merges, and B has no piece with a space behind another
character (checked when it is loaded; otherwise texts aren't cut).
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tulkki.llm.store import discard, materialise

FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which byte-level BPE splits text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT = re.compile(r"(?<=\w) (?=\w)")
ALIGNED = ("doc_id long, a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int>>, "
           "groups array<struct<a_end:int,b_end:int>>")
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, n_best long, count_sum long"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the others by number from 256."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteTokenizer:
    """Byte-level BPE from a ``tokenizers`` file, without special tokens."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab, alphabet = spec["model"]["vocab"], _byte_alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        plain = {bytes(alphabet[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.size = max(*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))) + 1
        self.pieces = [b""] * self.size
        for token, i in plain.items():
            self.pieces[i] = token
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        usual = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        if usual and merged == sorted(merged) and not spec["model"].get("ignore_merges"):
            # merges in the order of ids: ids are ranks, which a faster library takes
            self._ranked = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=plain, special_tokens={})
        else:
            self._ranked, self._any = None, tokenizers.Tokenizer.from_str(raw.decode())
            self._any.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self._ranked:
            return [self._ranked.encode_ordinary(t) for t in texts]
        return [self._any.encode(t, add_special_tokens=False).ids for t in texts]


class PieceTokenizer:
    """Piece BPE from a ``sentencepiece`` file, which puts a space before a text."""

    def __init__(self, raw: bytes):
        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.size = self._model.get_piece_size()
        names = [self._model.id_to_piece(i) for i in range(self.size)]
        self.pieces = [b"" if self._model.is_control(i) or self._model.is_unknown(i)
                       else bytes([int(p[1:-1], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.cuttable = not any(re.search("[^▁]▁", p) for p in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def _load(a: bytes, b: bytes) -> tuple[ByteTokenizer, PieceTokenizer]:
    return ByteTokenizer(a), PieceTokenizer(b)


def _stretches(text: str, most: int) -> Iterator[str]:
    """The text with a space before it, cut into stretches of about ``most`` characters that begin with a space."""
    lo = 0
    while len(text) - lo > most:
        cut = CUT.search(text, lo + most)
        if not cut:
            break
        yield " " + text[lo:cut.start()]
        lo = cut.start() + 1
    yield " " + text[lo:]


class Alignment:
    """Tokens of several stretches, laid end to end, and what they have in common.

    ``overlaps`` are pairs of token numbers (a, b) whose byte ranges meet,
    ``last_a`` and ``last_b`` the tokens at which both sides end.
    """

    def __init__(self, a: ByteTokenizer, b: PieceTokenizer, texts: list[str]):
        self.a_ids, self.b_ids = a.encode(texts), b.encode([t[1:] for t in texts])
        raw = [t.encode() for t in texts]
        self.fits = np.array([b"".join(map(a.pieces.__getitem__, x)) == r == b"".join(map(b.pieces.__getitem__, y))
                              for r, x, y in zip(raw, self.a_ids, self.b_ids, strict=True)], bool)
        if not self.fits.all():
            self.a_ids, self.b_ids = ([x if ok else [] for x, ok in zip(ids, self.fits, strict=True)] for ids in (self.a_ids, self.b_ids))
        self.a, self.a_end, left = self._side(self.a_ids, a.lengths, "a")
        self.b, self.b_end, right = self._side(self.b_ids, b.lengths, "b")
        # the covering token of the other side is the last one that starts no later
        covered = pd.merge_asof(left, right, on="start", by="doc")
        covering = pd.merge_asof(right, left.assign(a_start=left["start"]), on="start", by="doc")
        covering = covering[covering["a_start"] != covering["start"]]
        self.over_a = np.concatenate([covered["a"].to_numpy(), covering["a"].to_numpy()])
        self.over_b = np.concatenate([covered["b"].to_numpy(), covering["b"].to_numpy()])
        together = self.a_end[self.over_a] == self.b_end[self.over_b]
        self.last_a, self.last_b = np.sort(self.over_a[together]), np.sort(self.over_b[together])

    @staticmethod
    def _side(ids: list[list[int]], lengths: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray, pd.DataFrame]:
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.array(list(itertools.chain.from_iterable(ids)), np.int64)
        size = lengths[flat]
        end = np.cumsum(size)
        return flat, end, pd.DataFrame({"start": end - size, "doc": np.repeat(np.arange(len(ids)), counts), name: np.arange(len(flat))})

    def bounds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the tokens of A, those of B and the groups of each stretch begin, with the end of the last one."""
        a, b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64) for ids in (self.a_ids, self.b_ids))
        return a, b, np.searchsorted(self.last_a, a)

    def written(self) -> list[bytes]:
        """The groups of each stretch as ``a1,a2|b1;a3|b2,b3;``."""
        sides = []
        for last, n in ((self.last_a, len(self.a)), (self.last_b, len(self.b))):
            ends = np.zeros(n, np.int64)
            ends[last] = 1
            sides.append((np.cumsum(ends) - ends, ends))
        (group_a, ends_a), (group_b, ends_b) = sides
        order = np.argsort(np.concatenate([group_a * 2, group_b * 2 + 1]), kind="stable")
        codes = np.concatenate([self.a * 3 + ends_a, self.b * 3 + 2 * ends_b])[order].tolist()
        text = _written(int(max(self.a.max(initial=0), self.b.max(initial=0))) + 1)
        a, b, _ = self.bounds()
        cuts = (a + b).tolist()
        return ["".join([text[c] for c in codes[lo:hi]]).encode() for lo, hi in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(maxsize=1)
def _all_written(size: int) -> list[str]:
    return [f"{i}{end}" for i in range(size) for end in ",|;"]


def _written(size: int) -> list[str]:
    """Ids with what may follow them, for ids below the next power of two."""
    return _all_written(1 << max(16, size.bit_length()))


def _chunks(texts: pa.Array, most: int, cuttable: bool) -> Iterator[list[tuple[int, str]]]:
    """(row, stretch) pairs in portions of about ``most`` characters; null and empty texts have none."""
    portion, size = [], 0
    for row, text in enumerate(texts):
        text = text.as_py()
        for part in _stretches(text, most if cuttable else len(text)) if text else ():
            portion.append((row, part))
            size += len(part)
            if size >= most:
                yield portion
                portion, size = [], 0
    if portion:
        yield portion


def _pair_type(a: ByteTokenizer, b: PieceTokenizer) -> type:
    return np.uint32 if a.size * b.size < 1 << 32 else np.uint64


def _packed(links: list[np.ndarray], kind: type) -> bytes:
    """Pair codes in order, as differences."""
    codes = np.sort(np.concatenate(links)) if links else np.zeros(0, np.int64)
    return np.diff(codes, prepend=0).astype(kind).tobytes()


def _digests(files, most: int):
    """Counts, the digest of the groups, and the links of each document as one binary."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _load(*files.value)
        kind = _pair_type(a, b)
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, whole.num_rows, 512)):
            n = batch.num_rows
            fits, counts = np.ones(n, bool), np.zeros((4, n), np.int64)
            digest: list = [None] * n
            links: list[list[np.ndarray]] = [[] for _ in range(n)]
            for portion in _chunks(batch.column("text"), most, b.cuttable):
                both = Alignment(a, b, [t for _, t in portion])
                codes = both.a[both.last_a] * b.size + both.b[both.last_b]
                at_a, at_b, at_group = both.bounds()
                rows = np.array([r for r, _ in portion])
                for k, bounds in enumerate((at_a, at_b, at_group, at_group)):
                    np.add.at(counts[k], rows, np.diff(bounds))
                fits[rows[~both.fits]] = False
                for i, (row, text) in enumerate(zip(rows, both.written(), strict=True)):
                    if digest[row] is None:
                        digest[row] = hashlib.sha256(text[:-1])
                    else:
                        digest[row].update(b";" + text[:-1])
                    links[row].append(codes[at_group[i]:at_group[i + 1]])
            counts[:, ~fits] = 0
            have = fits & (counts[0] > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c) for c in counts],
                 pa.array([d.hexdigest() if ok else "" for d, ok in zip(digest, have, strict=True)]),
                 pa.array([_packed(x if ok else [], kind) for x, ok in zip(links, have, strict=True)], pa.binary()),
                 pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "n_best", "count_sum"])
    return task


def _unpack(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(codes, row of each) of packed links."""
    raw = [np.frombuffer(x.as_buffer(), kind) for x in column]
    codes = [np.cumsum(r, dtype=np.int64) for r in raw]
    return (np.concatenate(codes) if codes else np.zeros(0, np.int64)), np.repeat(np.arange(len(raw)), [len(r) for r in raw])


def _count(kind: type, most: int):
    """Partial counts of pair codes; what is held stays under ``most`` codes and the next batch."""
    def merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, at = np.unique(codes, return_inverse=True)
        return codes, np.bincount(at, counts, len(codes)).astype(np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                codes, _ = _unpack(batch.column("links").slice(lo, 256), kind)
                codes, counts = np.unique(codes, return_counts=True)
                held = merged(np.concatenate([held[0], codes]), np.concatenate([held[1], counts]))
                if len(held[0]) > most:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "n"])
                    held = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["code", "n"])
    return task


def _look_up(block, kind: type):
    """Add what a block of (code, count, is best) says about each document's links."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = block.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                codes, rows = _unpack(batch.column("links"), kind)
                at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                hit = known[at] == codes
                at, rows = at[hit], rows[hit]
                more = {"n_best": best[at].astype(np.int64), "count_sum": counts[at]}
                for name, values in more.items():
                    total = batch.column(name).to_numpy().copy()
                    np.add.at(total, rows, values)
                    batch = batch.set_column(batch.schema.get_field_index(name), name, pa.array(total))
                yield batch
    return task


def _files(spark, folder: str, a: str, b: str):
    """Both tokenizer files, a few megabytes of fixed size, for the tasks."""
    return spark.sparkContext.broadcast(tuple(open(f"{folder}/{name}", "rb").read() for name in (a, b)))


def aligned_tokens(docs: DataFrame, folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", stretch: int = 1 << 18) -> DataFrame:
    """The alignment itself, one row per input row: doc_id, a_ids, b_ids,
    overlaps (numbers of tokens whose byte ranges meet) and groups (numbers of
    the tokens that end each group).  Rows are treated as ``token_alignment`` does."""
    files = _files(docs.sparkSession, folder, a, b)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = _load(*files.value)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, pairs, ends = ([], []), ([], []), ([], [])
                for portion in _chunks(batch.column("text").slice(row, 1), stretch, second.cuttable):
                    both = Alignment(first, second, [t for _, t in portion])
                    if not both.fits.all():
                        ids, pairs, ends = ([], []), ([], []), ([], [])
                        break
                    before = [sum(map(len, x)) for x in ids]
                    for k, (own, over, last) in enumerate(((both.a, both.over_a, both.last_a), (both.b, both.over_b, both.last_b))):
                        ids[k].append(own)
                        pairs[k].append(over + before[k])
                        ends[k].append(last + before[k])
                flat = [[pa.array(np.concatenate(x or [np.zeros(0, np.int64)]).astype(np.int32)) for x in two] for two in (ids, pairs, ends)]
                order = pa.compute.sort_indices(pa.table(flat[1], names=["a", "b"]), [("a", "ascending"), ("b", "ascending")])
                one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, 1), one(flat[0][0]), one(flat[0][1]),
                     one(pa.StructArray.from_arrays([x.take(order) for x in flat[1]], ["a", "b"])),
                     one(pa.StructArray.from_arrays(flat[2], ["a_end", "b_end"]))], names=["doc_id", "a_ids", "b_ids", "overlaps", "groups"])

    return docs.select("doc_id", "text").mapInArrow(task, ALIGNED)


def token_alignment(docs: DataFrame, folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model",
                    stretch: int = 1 << 18, block_pairs: int = 1 << 20) -> DataFrame:
    """How two tokenizers' tokens align, one row per input row: doc_id, n_a,
    n_b (tokens), n_groups, n_links, n_best (links whose pair of ids is the
    most frequent of its B id in the corpus, ties included), count_sum (of the
    corpus counts of its links) and groups_sha256.

    Null and empty texts, and texts that either tokenizer doesn't give back
    byte by byte, have no tokens: zeros and an empty digest.  Strings of
    special tokens are plain text.  Each row counts as a document, repeated
    rows and null doc_ids included; other columns are left out, so clashing
    names don't matter; an empty table gives an empty result.  Texts are
    encoded in stretches of about ``stretch`` characters, ``block_pairs``
    counts of pairs are sent to the tasks at a time.  The tokenizer files
    named ``a`` and ``b`` are read from ``folder`` by the driver.
    """
    spark = docs.sparkSession
    files = _files(spark, folder, a, b)
    first, second = _load(*files.value)
    kind = _pair_type(first, second)
    current = materialise(docs.select("doc_id", "text").mapInArrow(_digests(files, stretch), DIGEST), "aligned")
    pairs = (current.select("links").mapInArrow(_count(kind, block_pairs), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
             .withColumn("b", F.col("code") % second.size))
    pairs = materialise(pairs, "pairs")
    most = pairs.groupBy("b").agg(F.max("n").alias("most"))
    blocks = -(-pairs.count() // block_pairs)
    known = pairs.join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    for i in range(blocks):
        some = known.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == i).orderBy("code").toArrow()
        block = spark.sparkContext.broadcast(tuple(some.column(c).to_numpy() for c in ("code", "n", "best")))
        done = current.mapInArrow(_look_up(block, kind), DIGEST)
        if i + 1 < blocks:
            done, spent = materialise(done, "counted"), current
            discard(spent)
        current = done
    discard(pairs)
    return current.drop("links")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    return token_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
