"""Alignment of two tokenizers over the same texts: cuts where tokens of both end, links between tokens of one group.

A byte-level tokenizer (A, a tokenizers JSON file) encodes a space and the text; a piece model (B, sentencepiece) encodes the text
and adds that space itself. Tokens are spans of the same bytes, so both sequences are walked at once. The walk is lockstep and
vectorised: one state vector holds, for every text of a batch, the numbers of the A and B token that come next and of those that
began the open group. A step compares the two tokens' last bytes for all texts, advances the token that ends first, or both where
they end together; there a cut is emitted with its group, and finished lanes leave the state vector. A long text is dealt to several
lanes, parted where tokens of both are known to end, so no step is made for a single text. Groups become links in bulk.

How many texts of the corpus hold a pair of ids linked is counted per batch first: a batch emits each of its pairs once with the
number of its texts that hold it, and keeps, per text, the numbers of its pairs in the batch's list. Corpus counts go back to the
batches that hold the pair, and sums are made there. So shuffles carry distinct pairs per batch, not links.

Defined cases: texts that are null or empty, or whose tokens' bytes differ from a space and the text in A or in B, have no tokens:
all numbers are zero and the digest is the empty text. Special tokens' strings in a text are plain text. Repeated rows are texts of
their own. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regrove.llm.common import blocks, pick, table, written

VOCABULARIES = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text (about 200 bytes of memory each) that are aligned together; a longer text is a batch of its own.
BATCH_CHARS = 2_500_000
#: A tokens of a lane, and how many further ones are looked at for a place to part it.
LANE, LOOK = 512, 64
#: Bits of a pair's number that hold the B id.
B_BITS = 20
#: Bits of a pair's number; above them stands the text's number in its batch.
PAIR_BITS = 40
#: Products of a group's A and B tokens up to which links are listed one by one.
PLAIN_LINKS = 1 << 12


# Fixed value: how a byte-level vocabulary of this kind parts a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of these characters (whose kinds no edition of Unicode tells apart) and lengths are merged by rank, which is faster.
_PLAIN = re.compile(r"[\x00-\u024f]{0,65536}\Z")


def by_rank(a_json: str, tokens: list[bytes]):
    """An encoder by ranks with the same results as the file's merges, or None if the file doesn't allow one.

    A merge made of two tokens is the only one that can come to its bytes if ids are in the order of the merges: then the lowest rank
    among neighbours is the next merge, and no other pair of neighbours spells the same token.
    """
    import tiktoken

    file = json.loads(a_json)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = not file.get("normalizer") and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    merged = [model["vocab"]["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in model["merges"]]
    if any(x >= y for x, y in zip(merged, merged[1:])):
        return None
    added = {x["id"] for x in file.get("added_tokens", [])}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(tokens) if i not in added}, special_tokens={})


def _byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, and the bytes of their tokens by id."""

    def __init__(self, a_json: str, b_model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work to its own tasks
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        alphabet = _byte_alphabet()
        self.a_bytes = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        added = {x["content"] for x in json.loads(a_json).get("added_tokens", [])}
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = token.encode() if token in added else bytes(alphabet[c] for c in token)
        self.ranks = by_rank(a_json, self.a_bytes)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Decimal ids with each mark that can follow them.
        self.shown = [np.array([f"{i}{mark}".encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))], object) for mark in (",", "|", ";", "")]

    def encode_a(self, spaced: list[str]) -> list[np.ndarray]:
        plain = [self.ranks is not None and bool(_PLAIN.match(t)) for t in spaced]
        others = iter(self.a.encode_batch_fast([t for t, p in zip(spaced, plain, strict=True) if not p], add_special_tokens=False))
        return [np.array(self.ranks.encode_ordinary(t) if p else next(others).ids, np.int64) for t, p in zip(spaced, plain, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A and B ids of each text; none where the bytes of either are not a space and the text."""
        spaced = [f" {t}" for t in texts]
        raw = [t.encode() for t in spaced]
        a = self.encode_a(spaced)
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        same = np.array([len(x) > 1 for x in raw], bool) & _same(self.a_bytes, self.a_sizes, a, raw) & _same(self.b_bytes, self.b_sizes, b, raw)
        none = np.zeros(0, np.int64)
        return [(x, y) if good else (none, none) for x, y, good in zip(a, b, same.tolist(), strict=True)]


def _same(table: list[bytes], sizes: np.ndarray, ids: list[np.ndarray], raw: list[bytes]) -> np.ndarray:
    """Whether each text's tokens joined are its bytes: lengths first, then all bytes of those at once."""
    found = np.array([int(sizes[x].sum()) == len(r) for x, r in zip(ids, raw, strict=True)], bool)
    some = np.flatnonzero(found).tolist()
    if some:
        starts = np.cumsum(sizes) - sizes
        every = np.concatenate([ids[k] for k in some])
        ends = np.cumsum(sizes[every])
        place = np.repeat(starts[every] - ends + sizes[every], sizes[every]) + np.arange(int(ends[-1]))
        wrong = np.flatnonzero(np.frombuffer(b"".join(table), np.uint8)[place] != np.frombuffer(b"".join([raw[k] for k in some]), np.uint8))
        last = np.cumsum([len(raw[k]) for k in some])
        found[np.array(some)[np.unique(np.searchsorted(last, wrong, side="right"))]] = False
    return found


@lru_cache(maxsize=2)
def _loaded(a_json: str, b_model: bytes) -> Pair:
    return Pair(a_json, b_model)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_stop: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, ...]:
    """Texts parted into pieces of about `lane` A tokens where an A and a B token end together: first A and B token, last A token, text."""
    size = a_stop - a_first
    n = np.maximum(size // lane, 1)
    text = np.repeat(np.arange(len(size)), n)
    part = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    inner = part > 0
    at = (a_first[text] + part * lane)[inner]
    near = at[:, None] + np.arange(LOOK)[None, :]  # tokens after which the parting may be
    near = np.minimum(near, a_stop[text[inner], None] - 1)
    place = np.searchsorted(b_ends, a_ends[near])
    both = (b_ends[np.minimum(place, max(len(b_ends) - 1, 0))] == a_ends[near]) & (near < a_stop[text[inner], None] - 1)
    found, which = both.any(1), both.argmax(1)
    rows = np.arange(len(at))[found]
    first_a = np.concatenate([a_first[size > 0], near[rows, which[found]] + 1])
    first_b = np.concatenate([b_first[size > 0], place[rows, which[found]] + 1])
    owner = np.concatenate([np.flatnonzero(size > 0), text[inner][found]])
    order = np.argsort(first_a, kind="stable")
    first_a, first_b, owner = first_a[order], first_b[order], owner[order]
    own = np.concatenate((first_a[1:] != first_a[:-1], [True])) if len(first_a) else np.zeros(0, bool)
    first_a, first_b, owner = first_a[own], first_b[own], owner[own]
    stop = np.minimum(np.concatenate((first_a[1:], a_stop[-1:])), a_stop[owner]) if len(first_a) else first_a
    return first_a, first_b, stop, owner


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_stop: np.ndarray, lane: int = LANE) -> np.ndarray:
    """Groups of many texts at once, a column each: text, first and last A token, first and last B token (ends exclusive), by text and place.

    `a_ends`, `b_ends` are the tokens' last bytes, text after text and counted on from text to text; text k has the A tokens from
    a_first[k] to a_stop[k] and the B tokens from b_first[k] on, over the same bytes.
    """
    a, b, stop, text = lanes(a_ends, b_ends, a_first, b_first, a_stop, lane)
    group_a, group_b = a.copy(), b.copy()
    cuts: list[list[np.ndarray]] = [[], [], [], [], []]
    while len(text):
        last_a, last_b = a_ends[a], b_ends[b]
        on_a, on_b = last_a <= last_b, last_b <= last_a
        a, b = a + on_a, b + on_b
        cut = np.flatnonzero(on_a & on_b)
        if len(cut):
            at_a, at_b = a[cut], b[cut]
            for to, x in zip(cuts, (text[cut], group_a[cut], at_a, group_b[cut], at_b), strict=True):
                to.append(x)
            group_a[cut], group_b[cut] = at_a, at_b
            if (at_a == stop[cut]).any():  # lanes whose last tokens these were leave
                live = a < stop
                text, a, b, stop, group_a, group_b = (x[live] for x in (text, a, b, stop, group_a, group_b))
    if not cuts[0]:
        return np.zeros((5, 0), np.int64)
    columns = [np.concatenate(x) for x in cuts]
    # A tokens are numbered text after text: a group's place is the number of cuts at or before its last one
    ends = np.zeros(len(a_ends) + 1, np.int64)
    ends[columns[2]] = 1
    place = np.cumsum(ends)[columns[2]] - 1
    groups = np.empty((5, len(place)), np.int64)
    for to, x in zip(groups, columns, strict=True):
        to[place] = x
    return groups


def link_pairs(groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(text and pair of ids in one number, times): all links, possibly repeated, in pieces; no times where each is one."""
    n_a, n_b = groups[2] - groups[1], groups[4] - groups[3]
    plain = n_a * n_b <= PLAIN_LINKS
    small = groups if plain.all() else groups[:, plain]
    edges = np.searchsorted(np.cumsum(n_a[plain] * n_b[plain]), np.arange(0, int((n_a[plain] * n_b[plain]).sum()) + 1, 2_000_000)[1:])
    for text, a0, a1, b0, b1 in np.split(small, edges, axis=1):
        if len(text):
            yield _plain_links(text, a0, a1, b0, b1, a_ids, b_ids), None
    for text, a0, a1, b0, b1 in groups[:, ~plain].T.tolist():  # long stretches without a cut: distinct ids with their counts
        a, times_a = np.unique(a_ids[a0:a1], return_counts=True)
        b, times_b = np.unique(b_ids[b0:b1], return_counts=True)
        step = max(1, 2_000_000 // len(b))
        for i in range(0, len(a), step):
            yield (text << PAIR_BITS | a[i:i + step, None] << B_BITS | b[None, :]).ravel(), (times_a[i:i + step, None] * times_b[None, :]).ravel()


def _plain_links(text: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
    """All links of groups, one by one; most groups are one token each, which need no counting out."""
    single = (a1 - a0 == 1) & (b1 - b0 == 1)
    ones = text[single] << PAIR_BITS | a_ids[a0[single]] << B_BITS | b_ids[b0[single]]
    text, a0, a1, b0, b1 = (x[~single] for x in (text, a0, a1, b0, b1))
    wide, sizes = b1 - b0, (a1 - a0) * (b1 - b0)
    within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    down, across = np.divmod(within, np.repeat(wide, sizes))
    a, b = np.repeat(a0, sizes) + down, np.repeat(b0, sizes) + across
    return np.concatenate([ones, np.repeat(text << PAIR_BITS, sizes) | a_ids[a] << B_BITS | b_ids[b]])


def _summed(keys: np.ndarray, times: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its times."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if times is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.diff(np.append(first, len(keys))) if times is None else np.add.reduceat(times, first)


def shown_groups(pair: Pair, groups: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_stop: np.ndarray, b_stop: np.ndarray) -> Iterator[bytes]:
    """Per text: its groups as `a1,a2|b1;a3|b2,b3`."""
    a_mark, b_mark = np.zeros(len(a_ids), np.int64), np.zeros(len(b_ids), np.int64)
    a_mark[groups[2] - 1] = 1
    b_mark[groups[4] - 1] = 2
    b_mark[b_stop[b_stop > b_first] - 1] = 3
    words_a = pair.shown[0][a_ids]
    words_a[a_mark == 1] = pair.shown[1][a_ids[a_mark == 1]]
    words_b = pair.shown[0][b_ids]
    for mark in (2, 3):
        words_b[b_mark == mark] = pair.shown[mark][b_ids[b_mark == mark]]
    # an A token stands after the B tokens of earlier groups, a B token after the A tokens of its own and earlier ones
    n_a, n_b = groups[2] - groups[1], groups[4] - groups[3]
    order = np.empty(len(a_ids) + len(b_ids), object)
    order[np.arange(len(a_ids)) + np.repeat(groups[3], n_a)] = words_a
    order[np.arange(len(b_ids)) + np.repeat(groups[2], n_b)] = words_b
    for lo, hi in zip((a_first + b_first).tolist(), (a_stop + b_stop).tolist(), strict=True):
        yield b"".join(order[lo:hi].tolist())


class Batch:
    """Aligned texts: per text the numbers of its tokens, groups and links and its digest, and which pairs it holds how often."""

    def __init__(self, pair: Pair, tokens: list[tuple[np.ndarray, np.ndarray]]) -> None:
        sizes = np.array([[len(a), len(b)] for a, b in tokens], np.int64).reshape(-1, 2)
        self.n_a, self.n_b = sizes[:, 0], sizes[:, 1]
        a_ids, b_ids = (np.concatenate([np.zeros(0, np.int64), *(t[k] for t in tokens)]) for k in (0, 1))
        a_stop, b_stop = np.cumsum(self.n_a), np.cumsum(self.n_b)
        a_first, b_first = a_stop - self.n_a, b_stop - self.n_b
        self.a_ends, self.b_ends = np.cumsum(pair.a_sizes[a_ids]), np.cumsum(pair.b_sizes[b_ids])
        self.groups = lockstep(self.a_ends, self.b_ends, a_first, b_first, a_stop)
        self.n_groups = np.bincount(self.groups[0], minlength=len(tokens))
        links = (self.groups[2] - self.groups[1]) * (self.groups[4] - self.groups[3])
        self.n_links = np.zeros(len(tokens), np.int64)
        np.add.at(self.n_links, self.groups[0], links)
        self.sha = ["" if not n else hashlib.sha256(line).hexdigest() for n, line in zip(self.n_a.tolist(), shown_groups(pair, self.groups, a_ids, b_ids, a_first, b_first, a_stop, b_stop), strict=True)]
        held = [_summed(keys, times) for keys, times in link_pairs(self.groups, a_ids, b_ids)]
        keys, times = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in range(2))
        if len(held) > 1:  # pieces end between groups, not texts: a text's pair may stand in two
            keys, times = _summed(keys, times)
        text, pairs = keys >> PAIR_BITS, keys & ((1 << PAIR_BITS) - 1)
        listed, place, texts = np.unique(pairs, return_inverse=True, return_counts=True)
        often = np.argsort(-texts, kind="stable")  # frequent pairs get small numbers, which pack well
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        self.pairs, self.texts = listed[often], texts[often]
        self.place, self.times = rank[place], times
        self.cuts = np.searchsorted(text, np.arange(len(tokens) + 1))

    def held(self, k: int) -> tuple[bytes, bytes]:
        """Numbers of text k's pairs in the batch's list, and how often each is linked, packed."""
        own = slice(int(self.cuts[k]), int(self.cuts[k + 1]))
        return pa.compress(self.place[own].astype("<u4").tobytes(), "zstd", asbytes=True), pa.compress(self.times[own].astype("<u4").tobytes(), "zstd", asbytes=True)


def _vocabularies(a_file: str, b_file: str) -> tuple[str, bytes]:
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        return a.read(), b.read()


def gathered(batches: Iterator[pa.RecordBatch], column: int, chars: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows in runs of about so many characters of text."""
    held, size = [], 0
    for part in blocks(batches):
        held.append(part)
        size += part.column(column).nbytes + 64 * part.num_rows  # empty texts count too
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_COUNTED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, id: str, text: str, a_file: str, b_file: str, batch_chars: int) -> DataFrame:
    """Per text its counts, digest and packed pairs, and per batch one more row (listed is true) with its pairs and their texts."""
    files = docs.sparkSession.sparkContext.broadcast(_vocabularies(a_file, b_file))  # two files of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(*files.value)
        names = ["listed", "batch", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times"]
        for number, parts in enumerate(gathered(batches, 1, batch_chars)):
            tokens = [t for part in parts for t in pair.encode([x or "" for x in part.column(1).to_pylist()])]
            found = Batch(pair, tokens)
            n, batch = len(tokens), TaskContext.get().partitionId() << 32 | number
            ids = pa.concat_arrays([part.column(0) for part in parts])
            for start in range(0, n, 1024):
                some = slice(start, min(n, start + 1024))
                size = some.stop - some.start
                held = [found.held(k) for k in range(some.start, some.stop)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([False] * size), pa.array([batch] * size, pa.int64()), ids.slice(start, size), *(pa.array(x[some]) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)),
                    pa.array(found.sha[some], pa.string()), pa.array([h[0] for h in held], pa.binary()), pa.array([h[1] for h in held], pa.binary())], names)
            one = [pa.array([True]), pa.array([batch], pa.int64()), pa.nulls(1, ids.type), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.string())]
            yield pa.RecordBatch.from_arrays([*one, pa.array([pa.compress(found.pairs.astype("<i8").tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([found.texts.astype("<u4").tobytes()], pa.binary())], names)

    picked = pick(docs, id, text).toDF("id", "text")
    schema = T.StructType([T.StructField("listed", T.BooleanType()), T.StructField("batch", T.LongType()), T.StructField("id", picked.schema["id"].dataType)])
    for name, kind in (x.split() for x in _COUNTED.split(", ")):
        schema.add(name, kind)
    return picked.mapInArrow(run, schema.add("places", "binary").add("times", "binary"))


def _pairs_of(listed: DataFrame) -> DataFrame:
    """(batch, place, pair, n): the pairs that each batch lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, 1):
            n = np.frombuffer(part.column(2)[0].as_py(), "<u4").astype(np.int64)
            pairs = np.frombuffer(pa.decompress(part.column(1)[0].as_py(), 8 * len(n), "zstd", asbytes=True), "<i8")
            for start in range(0, len(n), 65_536):
                some = slice(start, start + 65_536)
                size = len(n[some])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(size, part.column(0)[0].as_py())), pa.array(np.arange(start, start + size, dtype=np.int32)), pa.array(pairs[some]), pa.array(n[some])], ["batch", "place", "pair", "n"])

    return listed.select("batch", "places", "times").mapInArrow(run, "batch long, place int, pair long, n long")


def _sums(texts: pa.Table, values: pa.Table) -> pa.Table:
    """The texts of one batch with the sums over their links; `values` has place, count, best of every pair of the batch."""
    count, best = np.zeros(values.num_rows, np.int64), np.zeros(values.num_rows, np.int64)
    place = np.asarray(values.column("place"))
    count[place], best[place] = np.asarray(values.column("count")), np.asarray(values.column("best"))
    out: list[list[int]] = [[], []]
    # a text without tokens has packed nothing
    for packed, often, links in zip(texts.column("places").to_pylist(), texts.column("times").to_pylist(), texts.column("n_links").to_pylist(), strict=True):
        held, times = (np.frombuffer(_unpacked(x, links), "<u4").astype(np.int64) for x in (packed, often))
        out[0].append(int(times @ best[held]))
        out[1].append(int(times @ count[held]))
    names = ["id", *(x.split()[0] for x in _COUNTED.split(", "))]
    return pa.table([*(texts.column(c) for c in names), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=[*names, "n_best", "count_sum"])


def _unpacked(packed: bytes, links: int) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(packed), "zstd") as stream:
        return stream.read(4 * links)  # at most one number per link


def align(docs: DataFrame, id: str = "doc_id", text: str = "text", a_file: str = f"{VOCABULARIES}/{A_FILE}", b_file: str = f"{VOCABULARIES}/{B_FILE}", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Per row of `docs`: id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum."""
    rows = written(aligned(docs, id, text, a_file, b_file, batch_chars), "aligned")
    listed = _pairs_of(rows.where("listed"))
    counts = written(listed.groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    first = F.shiftright("pair", B_BITS)
    highest = counts.groupBy(first.alias("a")).agg(F.max("count").alias("highest"))  # a row per A id
    valued = counts.join(highest, first == F.col("a")).select("pair", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    values = listed.select("batch", "place", "pair").join(valued, "pair").select("batch", "place", "count", "best")
    texts = rows.where("not listed").drop("listed")
    fields = [texts.schema["id"], *(texts.schema[x.split()[0]] for x in _COUNTED.split(", ")), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]
    tied = texts.where("n_links > 0").groupBy("batch").cogroup(values.groupBy("batch")).applyInArrow(_sums, T.StructType(fields))
    names = [f.name for f in fields]
    without = texts.where("n_links = 0").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).select(*names)
    return tied.union(without).withColumnRenamed("id", id)


def cuts(docs: DataFrame, id: str = "doc_id", text: str = "text", a_file: str = f"{VOCABULARIES}/{A_FILE}", b_file: str = f"{VOCABULARIES}/{B_FILE}", batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Per row of `docs`: id, a_ids, b_ids and, per group, a_stop and b_stop (tokens up to its end) and byte (its end in space and text)."""
    files = docs.sparkSession.sparkContext.broadcast(_vocabularies(a_file, b_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _loaded(*files.value)
        for parts in gathered(batches, 1, batch_chars):
            for part in parts:
                tokens = pair.encode([x or "" for x in part.column(1).to_pylist()])
                out: list[list] = [[], [], [], [], []]
                for a, b in tokens:
                    ends = np.cumsum(pair.a_sizes[a])
                    zero = np.zeros(1, np.int64)
                    groups = lockstep(ends, np.cumsum(pair.b_sizes[b]), zero, zero, np.array([len(a)]))
                    for to, x in zip(out, (a, b, groups[2], groups[4], ends[groups[2] - 1]), strict=True):
                        to.append(x.tolist())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.list_(pa.int64())) for x in out)], ["id", "a_ids", "b_ids", "a_stop", "b_stop", "byte"])

    picked = pick(docs, id, text).toDF("id", "text")
    arrays = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("a_ids", "b_ids", "a_stop", "b_stop", "byte")]
    return picked.mapInArrow(run, T.StructType([picked.schema["id"], *arrays])).withColumnRenamed("id", id)


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
