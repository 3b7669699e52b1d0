"""Katz backoff language model over words: counts, discounts, backoff weights and the scores of texts.

P(w | h) is the discounted count of the n-gram over the count of its history; an n-gram that
training never saw gets what the discounts left over, shared out in proportion to P(w | h'), where
h' is h without its first word. Counts up to FEW are discounted by Good-Turing ratios from the
number of n-grams that occur once, twice, ...; at the bottom, what is left over is the probability
of an unknown word, so that P(. | h) sums to one over the vocabulary and the unknown word.

Texts are cut into blocks of about a million tokens, written once. For each order a block sends
its distinct n-grams to the partitions of that order's table, by history, and gets counts and the
state of the histories back; a partition sums the counts of all blocks and stores its n-grams.
N-grams travel as sorted packets of word numbers, so they are exact, and a frequent one is a single
entry per block. The continuations of a history that occurs too often for one partition are dealt
to all of them, and its sums are added up afterwards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from burnish.functions.scratch import scratch_path, stage
from burnish.llm.frames import arrow_schema
from burnish.llm.packing import narrow, pack, squeeze, unpack, unsqueeze

#: Tokens of a block, requests of a table partition, and occurrences above which a history is dealt to all partitions.
BLOCK, PART, HOT = 1 << 20, 1 << 19, 200_000
#: Histories dealt to all partitions are at most this many: HOT rises with the number of tokens.
MOST_HOT = 500_000
#: Counts above FEW are taken as they are.
FEW = 5
#: Numbers of words: unknown, the start of a text; words of the training texts follow.
UNKNOWN, START, FIRST = 0, 1, 2
#: Local codes in a block: the end of a text, its start; words follow.
END_CODE, START_CODE = 0, 1
#: Between the words of a packet; no word holds white space.
END = b"\n"

_BLOCK = "block long, row array<long>, doc_id array<long>, train array<boolean>, length array<int>, part array<int>, tokens binary, words binary"
_STATE = _BLOCK + ", state array<binary>"
_PACKET = "owner long, block long, grams array<binary>, amounts array<binary>"
_ANSWER = "kind string, owner long, block long, grams array<binary>, amounts array<binary>, few array<long>"
_SCORE = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Discounts:
    """What is kept of a count up to FEW, for one order."""

    kept: tuple[float, ...]

    @staticmethod
    def of(n: list[int]) -> Discounts:
        """From the numbers of n-grams that occur 1, 2, ..., FEW + 1 times.

        The largest range of counts is discounted whose ratios all lie between 0 and 1; else none is.
        """
        for k in range(FEW, 0, -1):
            if min(n[: k + 1]) <= 0:
                continue
            tail = (k + 1) * n[k] / n[0]
            if tail >= 1:
                continue
            ratios = [((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in ratios):
                return Discounts(tuple(d * r for r, d in enumerate(ratios, 1)))
        return Discounts(())

    def count(self, c: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        out = c.astype(float)
        small = (c > 0) & (c <= len(self.kept))
        out[small] = np.array((0.0, *self.kept))[c[small].astype(np.int64)]
        return out

    def lost(self, few: np.ndarray) -> np.ndarray:
        """What the discounts took from histories with ``few[:, r - 1]`` continuations of count r."""
        taken = np.array([r - kept for r, kept in enumerate(self.kept, 1)])
        return few[:, : len(taken)].astype(float) @ taken

    def state(self, total: np.ndarray, few: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Divisors of histories and the factors of P(w | h') after them.

        A history that lost nothing counts once more, and that goes to the words it never had.
        """
        lost = self.lost(few)
        spare = lost <= 0
        over = total + spare
        return over, np.where(spare, 1.0, lost) / np.maximum(over, 1) / np.maximum(1 - seen, 2.0**-53)


@dataclass(frozen=True)
class Model:
    """Numbers that hold for the whole model, and where its tables are."""

    order: int
    starts: int
    tokens: int
    words: int
    hot: int
    path: str
    #: By order from 1: discounts, and of the histories dealt to all partitions (word numbers, few, seen).
    discounts: list[Discounts] = field(default_factory=list)
    often: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def unigrams(self, few: list[int]) -> tuple[float, float]:
        """The divisor of single words, and the probability of an unknown one."""
        over, rest = self.discounts[0].state(np.array([self.tokens]), np.array([few[:FEW]]), np.zeros(1))
        return float(over[0]), float(rest[0])


class Block:
    """The n-grams of a block's texts, as positions and as distinct ones."""

    def __init__(self, row: dict, model_order: int, upto: int):
        self.row, self.order = row, model_order
        self.tokens = unpack(row["tokens"]).astype(np.int64)
        words = unsqueeze(row["words"])
        self.words = words.split(END) if words else []
        # The words themselves are dropped once they have numbers.
        size = len(unpack(row["state"][0])) if row.get("state") else len(self.words) + 2
        lengths = np.array(row["length"], np.int64)
        context = model_order - 1
        spans = lengths + context
        begins = np.cumsum(spans) - spans
        self.at = np.arange(len(self.tokens)) - np.repeat(begins, spans)
        self.document = np.repeat(np.arange(len(lengths)), spans)
        self.scored = self.at >= context
        self.train = self.scored & np.array(row["train"], bool)[self.document]
        #: By order: the gram that ends at each position (-1: none), and of the distinct ones history, last word, shorter gram, whether it is starts alone.
        self.ends, self.history, self.last, self.shorter, self.blank = [self.tokens], [None], [np.arange(size)], [None], [np.arange(size) == START_CODE]
        for _ in range(2, upto + 1):
            self._longer(size)
        self.counts: list[np.ndarray] = []
        self.over: list[np.ndarray | None] = []
        self.rest: list[np.ndarray | None] = []

    def _longer(self, size: int) -> None:
        """The next order, from the grams that end one place earlier."""
        before = np.full(len(self.tokens), -1)
        before[1:] = self.ends[-1][:-1]
        before[self.at == 0] = -1
        places = np.flatnonzero(before >= 0)
        found = before[places] * size + self.tokens[places]
        order = np.argsort(found)
        new = runs([found[order]])
        ends = np.empty(len(found), np.int64)
        ends[order] = np.cumsum(new) - 1
        whole = np.full(len(self.tokens), -1)
        whole[places] = ends
        keys = found[order][new]
        shorter = np.empty(len(keys), np.int64)
        shorter[ends] = self.ends[-1][places]
        self.shorter.append(shorter)
        self.ends.append(whole)
        self.history.append(keys // size)
        self.last.append(keys % size)
        self.blank.append(self.blank[-1][keys // size] & (keys % size == START_CODE))

    def amounts(self, n: int) -> np.ndarray:
        """How often training texts of this block hold each distinct n-gram."""
        return np.bincount(self.ends[n - 1][self.train], minlength=len(self.last[n - 1]))

    def numbers(self, n: int, which: np.ndarray) -> list[np.ndarray]:
        """The word numbers of the chosen n-grams, first word first."""
        out: list[np.ndarray] = []
        for level in range(n - 1, 0, -1):
            out.append(self.ids[self.last[level][which]])
            which = self.history[level][which]
        return [*reversed([*out, self.ids[which]])]

    def known(self, counts: np.ndarray, model: Model, n: int) -> np.ndarray:
        """The counts of n-grams as histories: texts start as often as there are training texts."""
        return np.where(self.blank[n - 1], model.starts, counts)

    def asked(self, n: int, model: Model, owners: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """The n-grams after a known history, to be looked up: their places, numbers, owners, and whether dealt to all."""
        total = self.known(self.counts[n - 2], model, n - 1)[self.history[n - 1]]
        which = np.flatnonzero(~self.blank[n - 1] & (total > 0))
        ids, dealt = self.numbers(n, which), total[which] > model.hot
        owner = mixed(ids[:-1])
        owner = np.where(dealt, mixed([owner, ids[-1]]), owner) % np.uint64(owners)
        order = sorted_places(ids)
        order = order[np.argsort(owner[order].astype(np.uint16 if owners <= 1 << 16 else np.int64), kind="stable")]
        return which[order], [i[order] for i in ids], owner[order].astype(np.int64), dealt[order]


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of rows of whole numbers."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def sorted_places(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows of whole numbers, none negative; two columns are sorted as one where they fit 63 bits."""
    if len(columns) == 2 and len(columns[0]) and (bits := int(columns[1].max()).bit_length()) + int(columns[0].max()).bit_length() < 64:
        return np.argsort((columns[0] << bits) | columns[1])
    return np.lexsort((*reversed(columns),))


def runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where sorted rows begin that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8, A to Z lowered: what bytes.lower() and bytes.split() do."""
    return text.lower().split()


class Codes(dict):
    """Numbers for words from 2 on, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 2
        return number


# -- blocks --------------------------------------------------------------------------------------


def blocks(df: DataFrame, train: Column, order: int, key: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """The texts as token codes, about ``size`` tokens a row. A longer text goes on in the next block."""
    source = df.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body")
    )
    schema, context = arrow_schema(_BLOCK), order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        number = row = base
        codes = Codes()
        held: list[np.ndarray] = []
        lines: list[tuple] = []
        n = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(held)
            columns = [*map(list, zip(*lines))]
            words = squeeze(END.join(codes))
            return pa.RecordBatch.from_arrays(
                [pa.array([x], f.type) for x, f in zip([number, *columns, pack(flat), words], schema)], schema=schema
            )

        for batch in batches:
            for doc_id, learn, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row += 1
                before, found, part, end = [START_CODE] * context, tokens_of(body), 0, False
                at = 0
                while not end:
                    room = max(size - n, 1)
                    part_of = found[at : at + room]
                    at += len(part_of)
                    end = len(part_of) < room and at >= len(found)
                    piece = [*before, *map(codes.__getitem__, part_of), *([END_CODE] if end else [])]
                    held.append(np.array(piece, np.uint32))
                    piece = piece[context:]
                    lines.append((row, doc_id, learn, len(piece), part))
                    n, part = n + len(piece), part + 1
                    if n >= size:
                        tail = [found[i] if i >= 0 else None for i in range(at - context, at)]
                        yield flush()
                        number, codes, held, lines, n = number + 1, Codes(), [], [], 0
                        if not end:
                            before = [START_CODE if w is None else codes[w] for w in tail]
        if lines:
            yield flush()

    return stage(source.mapInArrow(run, _BLOCK), "blocks")


def _per_row(fn, ddl: str):
    """A function on batches from a generator of rows of one input row."""
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(fn(batch.slice(i, 1).to_pylist()[0]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _owned(packets: DataFrame, owners: int):
    return packets.repartition(owners, "owner").groupBy("owner")


def _answers(model_path: str, order: int, answers: DataFrame) -> tuple[DataFrame, list[int]]:
    """Written answers of an order, and how many of its n-grams occur 1, 2, ..., FEW + 1 times."""
    path = f"{model_path}/order={order}"
    answers.write.partitionBy("kind").parquet(path)
    read = answers.sparkSession.read.schema(answers.schema).parquet(path)
    sums = read.where("kind = 'grams'").agg(*(F.coalesce(F.sum(F.col("few")[r]), F.lit(0)) for r in range(FEW + 2))).first()
    return read, [int(x) for x in sums]


# -- single words --------------------------------------------------------------------------------


def _word_packets(order: int, owners: int):
    def run(row: dict) -> Iterator[tuple]:
        block = Block(row, order, 1)
        count, by_owner = block.amounts(1), _words_by_owner(block, owners)
        for owner, places in by_owner.items():
            words = END.join([block.words[p] for p in places])
            yield owner, row["block"], [squeeze(words)], [pack(narrow(count[np.array(places) + 2]))]

    return _per_row(run, _PACKET)


def _words_by_owner(block: Block, owners: int) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for place, word in enumerate(block.words):
        out.setdefault(zlib.crc32(word) % owners, []).append(place)
    return out


def _count_words(owners: int):
    schema = arrow_schema(_ANSWER)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        owner, total = rows[0]["owner"], {}
        packets = [(r["block"], unsqueeze(r["grams"][0]).split(END), unpack(r["amounts"][0]).astype(np.int64)) for r in rows]
        for _, words, counts in packets:
            for w, c in zip(words, counts.tolist()):
                total[w] = total.get(w, 0) + c
        known = sorted(w for w, c in total.items() if c)
        number = {w: FIRST + 1 + i * owners + owner for i, w in enumerate(known)}
        counts = np.array([total[w] for w in known], np.int64)
        out = [("grams", owner, None, [squeeze(END.join(known))], [pack(narrow(counts))], _few(counts))]
        for block, words, _ in packets:
            ids = np.array([number.get(w, UNKNOWN) for w in words], np.int64)
            c = np.array([total[w] for w in words], np.int64)
            out.append(("answer", owner, block, [pack(narrow(ids))], [pack(narrow(c))], None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _few(counts: np.ndarray) -> list[int]:
    """How many counts are 1, 2, ..., FEW + 1, and how many there are."""
    return [*(int((counts == r).sum()) for r in range(1, FEW + 2)), int((counts > 0).sum())]


# -- longer n-grams ------------------------------------------------------------------------------


def _gram_packets(n: int, model: Model, few: list[int], owners: int):
    def run(row: dict) -> Iterator[tuple]:
        block = restored(row, model, few, n)
        which, ids, owner, dealt = block.asked(n, model, owners)
        amounts = block.amounts(n)[which]
        low = block.shorter[n - 1][which]
        low_count = block.counts[n - 2][low]
        over = np.full(len(which), block.over[0], np.int64) if n == 2 else block.over[n - 2][block.history[n - 2][low]].astype(np.int64)
        for a, b in _spans(owner):
            yield (
                int(owner[a]), row["block"], [pack(narrow(i[a:b])) for i in ids],
                [pack(narrow(amounts[a:b])), pack(narrow(low_count[a:b])), pack(narrow(over[a:b])), pack(dealt[a:b].astype(np.uint8))],
            )

    return _per_row(run, _PACKET)


def _spans(owner: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(runs([owner]))
    return zip(cuts.tolist(), [*cuts[1:].tolist(), len(owner)])


def _count_grams(lower: Discounts):
    schema = arrow_schema(_ANSWER)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        owner = rows[0]["owner"]
        parts = [[unpack(g).astype(np.int64) for g in (*r["grams"], *r["amounts"])] for r in rows]
        columns = [np.concatenate(c) for c in zip(*parts)]
        ids, (amount, low_count, over, dealt) = columns[:-4], columns[-4:]
        order = sorted_places(ids)
        ids = [i[order] for i in ids]
        new = runs(ids)
        gram = np.cumsum(new) - 1
        total = np.bincount(gram, weights=amount[order].astype(float)).astype(np.int64)
        # The shorter gram of one that training holds is known to every block that asks for it.
        heads = order[new]
        seen = np.where(total > 0, lower.count(low_count[heads]) / np.maximum(over[heads], 1), 0.0)
        fresh = runs([i[new] for i in ids[:-1]])
        history = np.cumsum(fresh) - 1
        few = np.stack([np.bincount(history, weights=(total == r)) for r in range(1, FEW + 1)], 1).astype(np.int64)
        seen = np.bincount(history, weights=seen)
        known, hot = total > 0, (dealt[heads] > 0)[fresh]
        stored = [pack(narrow(i[new][known])) for i in ids]
        out = [("grams", owner, None, stored, [pack(narrow(total[known]))], _few(total))]
        if hot.any():
            names = [pack(narrow(i[new][fresh][hot])) for i in ids[:-1]]
            out.append(("often", owner, None, names, [pack(few[hot].reshape(-1)), pack(seen[hot])], None))
        back = np.empty(len(order), np.int64)
        back[order] = gram
        at = 0
        for r, part in zip(rows, parts):
            mine = back[at : at + len(part[0])]
            at += len(part[0])
            first = history[mine[runs(part[: len(ids) - 1])]]
            open_ended = np.zeros(len(seen), bool)
            open_ended[history[mine[total[mine] == 0]]] = True
            sums = np.where(open_ended[first], seen[first], 0.0)
            answer = [pack(narrow(total[mine])), pack(few[first].reshape(-1)), pack(sums)]
            out.append(("answer", owner, r["block"], [], answer, None))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def _hot_histories(answers: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the histories dealt to all partitions; at most MOST_HOT."""
    width = n - 1
    ddl = "history array<long>, few array<long>, seen double"

    def spelled(row: dict) -> Iterator[tuple]:
        ids = np.stack([unpack(g).astype(np.int64) for g in row["grams"]], 1)
        few = unpack(row["amounts"][0]).reshape(-1, FEW)
        yield from zip(ids.tolist(), few.tolist(), unpack(row["amounts"][1]).tolist())

    rows = answers.where("kind = 'often'").mapInArrow(_per_row(spelled, ddl), ddl)
    sums = rows.groupBy("history").agg(*(F.sum(F.col("few")[r]).alias(f"few_{r}") for r in range(FEW)), F.sum("seen").alias("seen")).collect()
    sums = sorted(sums, key=lambda r: r["history"])
    ids = np.array([r["history"] for r in sums], np.int64).reshape(-1, width)
    few = np.array([[r[f"few_{i}"] for i in range(FEW)] for r in sums], np.int64).reshape(-1, FEW)
    return ids, few, np.array([r["seen"] for r in sums], float)


def _taken(block: Block, answers: list[dict], n: int, model: Model, owners: int) -> list[bytes]:
    """What a block keeps of the answers of order ``n``: counts, and few and seen of its histories."""
    by_owner = {a["owner"]: a for a in answers}
    if n == 1:
        ids, counts = np.zeros(len(block.words) + 2, np.int64), np.zeros(len(block.words) + 2, np.int64)
        ids[[END_CODE, START_CODE]], counts[END_CODE] = (FIRST, START), model.starts
        for owner, places in _words_by_owner(block, owners).items():
            at = np.array(places) + 2
            ids[at] = unpack(by_owner[owner]["grams"][0])
            counts[at] = unpack(by_owner[owner]["amounts"][0])
        return [pack(narrow(ids)), pack(narrow(counts))]
    which, _, owner, _ = block.asked(n, model, owners)
    size, before = len(block.last[n - 1]), len(block.last[n - 2])
    counts, kinds, seen = np.zeros(size, np.int64), np.zeros((before, FEW), np.int64), np.zeros(before)
    for a, b in _spans(owner):
        got = by_owner[int(owner[a])]["amounts"]
        counts[which[a:b]] = unpack(got[0])
        names = block.history[n - 1][which[a:b]]
        first = names[runs([names])]
        kinds[first], seen[first] = unpack(got[1]).reshape(-1, FEW), unpack(got[2])
    return [pack(narrow(counts)), pack(kinds.reshape(-1).astype(np.uint32)), pack(seen)]


def restored(row: dict, model: Model, few: list[int], upto: int) -> Block:
    """The block with its grams up to an order, and counts, divisors and factors of all orders answered so far."""
    block, state = Block(row, model.order, upto), row["state"]
    block.ids = unpack(state[0]).astype(np.int64)
    block.counts = [unpack(state[1]).astype(np.int64)]
    over, rest = model.unigrams(few)
    block.over, block.rest = [over], [rest]
    for n in range(2, 2 + (len(state) - 2) // 3):
        _add(block, n, model, state[3 * n - 4 : 3 * n - 1])
    return block


def _add(block: Block, n: int, model: Model, taken: list[bytes]) -> None:
    """The answers of order ``n``."""
    counts, kinds, seen = (unpack(s) for s in taken)
    kinds, seen = kinds.astype(np.int64).reshape(-1, FEW), seen.copy()
    total = block.known(block.counts[n - 2], model, n - 1)
    hot = np.flatnonzero(total > model.hot)
    if len(hot):
        ids, few_of, seen_of = model.often[n - 1]
        place = {tuple(i): p for p, i in enumerate(ids.tolist())}
        for h, name in zip(hot.tolist(), zip(*(x.tolist() for x in block.numbers(n - 1, hot)))):
            if (p := place.get(name)) is not None:
                kinds[h], seen[h] = few_of[p], seen_of[p]
    over, rest = model.discounts[n - 1].state(total, kinds, seen)
    block.counts.append(counts.astype(np.int64))
    block.over.append(over)
    block.rest.append(rest)


def log_scores(block: Block, model: Model) -> np.ndarray:
    """log10 P of the word at each position, from single words up to the whole order."""
    words = block.counts[0]
    p = np.where(words > 0, model.discounts[0].count(words) / block.over[0], block.rest[0])
    with np.errstate(divide="ignore"):
        score = np.log10(p)
        for n in range(2, model.order + 1):
            history, counts = block.history[n - 1], block.counts[n - 1]
            total = block.known(block.counts[n - 2], model, n - 1)[history]
            shorter = score[block.shorter[n - 1]]
            seen = np.log10(model.discounts[n - 1].count(counts) / np.maximum(block.over[n - 1][history], 1))
            unseen = np.log10(block.rest[n - 1][history]) + shorter
            score = np.where(total <= 0, shorter, np.where(counts > 0, seen, unseen))
    return score


# -- the whole -----------------------------------------------------------------------------------


def katz_scores(
    df: DataFrame, train: Column, order: int = 2, key: str = "doc_id", text: str = "text", block: int = BLOCK, part: int = PART, hot: int = HOT
) -> tuple[DataFrame, Model]:
    """Scores of all texts under a model of order ``order`` learnt from rows where ``train`` is true, and the model.

    ``doc_id, n_tokens, n_known, train_tokens, base_score, score``, a row per input row. Tokens are
    words, A to Z lowered, and one end a text; ``n_known`` of them occur in training. ``base_score``
    adds a half to each count of single words. A null text counts as empty (an end alone), a null
    ``train`` as false; repeated rows count as often as they occur and null keys are kept; other
    columns are ignored whatever their names; without training rows every word is unknown and all
    scores are 0; an empty table gives an empty result. The tables of the model lie under
    ``model.path``, by order, partitioned by history: word numbers and counts, rows of kind ``grams``.
    """
    spark = df.sparkSession
    state = blocks(df, train, order, key, text, block)
    lines = state.select(F.explode(F.arrays_zip("train", "length", "part")).alias("x")).select("x.*")
    sums = lines.agg(
        F.sum(F.when(F.col("train"), F.col("length").cast("long"))), F.count(F.when(F.col("train") & (F.col("part") == 0), 1)), F.sum("length")
    ).first()
    trained, starts, every = (int(x or 0) for x in sums)
    owners = max(spark.sparkContext.defaultParallelism, every // part)
    path = scratch_path(spark, "katz")
    model = Model(order, starts, trained, 0, max(hot, trained // MOST_HOT), path)
    few: list[int] = [0] * (FEW + 2)
    for n in range(1, order + 1):
        if n == 1:
            packets = state.mapInArrow(_word_packets(order, owners), _PACKET)
            answers = _owned(packets, owners).applyInArrow(_count_words(owners), _ANSWER)
        else:
            packets = state.mapInArrow(_gram_packets(n, model, few, owners), _PACKET)
            answers = _owned(packets, owners).applyInArrow(_count_grams(model.discounts[-1]), _ANSWER)
        answers, found = _answers(path, n, answers)
        often = (np.zeros((0, n - 1), np.int64), np.zeros((0, FEW), np.int64), np.zeros(0)) if n == 1 else _hot_histories(answers, n)
        if n == 1 and starts:  # the end of a text is a word that every block has
            found[-1] += 1
            if starts <= FEW + 1:
                found[starts - 1] += 1
        words = found[-1] if n == 1 else model.words
        model = Model(order, starts, trained, words, model.hot, path, [*model.discounts, Discounts.of(found)], [*model.often, often])
        few = found if n == 1 else few
        state = _next_state(state, answers, n, model, few, owners)
        if n < order:
            state = stage(state, "katz-state")
    parts = state.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return parts.select("doc_id", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), "base_score", "score"), model


def _next_state(state: DataFrame, answers: DataFrame, n: int, model: Model, few: list[int], owners: int) -> DataFrame:
    """The blocks with the answers of order ``n``; after the last order the scores of their texts."""
    last = n == model.order
    names = arrow_schema(_STATE).names
    schema = arrow_schema(_SCORE if last else _STATE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row, model.order, 1) if n == 1 else restored(row, model, few, n)
        new = _taken(block, right.to_pylist(), n, model, owners)
        if not last:
            row["state"], row["words"] = [*(row.get("state") or []), *new], squeeze(b"")
            return pa.table([pa.array([row[c]], f.type) for c, f in zip(names, schema)], schema=schema)
        if n == 1:
            row["state"] = new
            block = restored(row, model, few, 1)
        else:
            _add(block, n, model, new)
        score, words, scored = log_scores(block, model), block.counts[0], block.scored
        base = np.log10((words + 0.5) / (model.tokens + 0.5 * (model.words + 1)))[block.tokens]
        size, doc = len(row["row"]), block.document[scored]
        sums = [np.bincount(doc, weights=x[scored].astype(float), minlength=size) for x in (words[block.tokens] > 0, base, score[block.ends[-1]])]
        return pa.table(
            [pa.array(c, f.type) for c, f in zip([row["row"], row["doc_id"], row["length"], sums[0].astype(np.int64), sums[1], sums[2]], schema)], schema=schema
        )

    mine = answers.where("kind = 'answer'").select("block", "owner", "grams", "amounts")
    return state.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(run, _SCORE if last else _STATE)
