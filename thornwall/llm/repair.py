"""Repair of conversation structure by cheapest edits, evaluated on a grammar of the conversations.

Turns become letters (role initial and fault), conversations strings of letters, long ones several strings. Re-Pair
replaces frequent pairs of letters in all strings by new symbols, counted by Spark in rounds. An edit automaton over
``(s?(ua)+)?`` gives each symbol one matrix: for every state before and after, the least cost and the edits that are
ASCII-least at that cost, as a rope that shares the ropes of its parts. The matrix of a rule is the min-plus product of
its two parts, worked out once, bottom-up, for all conversations; a string is a product over its few symbols, and the
strings of one conversation multiply in any grouping. Texts move once, after the edits are known.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from thornwall.llm.common import parts, task_name, written

#: Fixed: white space.
SPACE = " \t\n\x0b\x0c\r"
#: Letters of a string at most, strings that meet in one product, strings whose matrices a worker remembers.
BLOCK, FAN, MEMO = 4096, 32, 50_000
#: Rounds of pairing, and pairs that a round may replace.
ROUNDS, PAIRS = 12, 64
#: Letters: delete (blank or repeated), or the initial of the role, upper case where the text is cut off.
DELETE, OTHER = "d", "o"
FIRST_RULE = 0x100
#: Costs of the edits.
DROP, REROLE, INSERT, CUT = 3, 2, 2, 1
#: States: nothing yet, after s, after u, after a. What a user or assistant turn leads to, by state before.
STATES = 4
USER, ASSISTANT = {0: 2, 1: 2, 3: 2}, {2: 3}
ENDS = (0, 3)
SHORT = 48


class Rope:
    """A text as a leaf, or as two ropes that others may share."""

    __slots__ = ("left", "right", "size", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None) -> None:
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if text is not None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.size + other.size <= SHORT and self.text is not None and other.text is not None:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __str__(self) -> str:
        found, stack = [], [self]
        while stack:
            rope = stack.pop()
            if rope.text is not None:
                found.append(rope.text)
            else:
                stack += (rope.right, rope.left)
        return "".join(found)

    def __lt__(self, other: Rope) -> bool:
        left, right = [self], [other]
        while left and right:
            a, b = left.pop(), right.pop()
            if a is b:
                continue
            if a.text is not None and b.text is not None:
                many = min(a.size, b.size)
                if a.text[:many] != b.text[:many]:
                    return a.text < b.text
                if a.size > many:
                    left.append(Rope(a.text[many:]))
                if b.size > many:
                    right.append(Rope(b.text[many:]))
            elif b.text is not None or a.text is None and a.size >= b.size:
                left += (a.right, a.left)
                right.append(b)
            else:
                right += (b.right, b.left)
                left.append(a)
        return bool(right)


Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def _least(cells: Iterable[Cell]) -> Cell:
    best: Cell = None
    for cell in cells:
        if cell is not None and (best is None or cell[0] < best[0] or cell[0] == best[0] and cell[1] < best[1]):
            best = cell
    return best


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: first ``a``, then ``b``. Ropes are joined only where the cost is least."""
    out: Matrix = []
    for row in a:
        line: list[Cell] = []
        for j in range(STATES):
            costs = [row[k][0] + b[k][j][0] if row[k] is not None and b[k][j] is not None else None for k in range(STATES)]
            known = [c for c in costs if c is not None]
            low = min(known) if known else None
            line.append(None if low is None else _least((low, row[k][1] + b[k][j][1]) for k in range(STATES) if costs[k] == low))
        out.append(line)
    return out


def identity() -> Matrix:
    return [[(0, Rope("")) if i == j else None for j in range(STATES)] for i in range(STATES)]


def _inserts() -> Matrix:
    """Any number of inserted turns: each state leads to the states after it at the cost of the turns between."""
    out = identity()
    for i in range(STATES):
        state, many = i, 0
        while many < 2:
            state, many = (3 if state == 2 else 2), many + 1
            if out[i][state] is None:
                out[i][state] = (INSERT * many, Rope("I" * many))
    return out


def letter_matrix(letter: str) -> Matrix:
    """Inserted turns, then one edit of a turn."""
    extra = CUT if letter.isupper() else 0
    step: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        step[i][i] = (DROP, Rope("D"))
    if letter != DELETE:
        for i in range(STATES):
            for role, ways in (("u", USER), ("a", ASSISTANT)):
                if i in ways:
                    kept = letter.lower() == role
                    cell = (extra, Rope("K")) if kept else (REROLE + extra, Rope("R"))
                    step[i][ways[i]] = _least([step[i][ways[i]], cell])
        if letter.lower() == "s":
            step[0][1] = (extra, Rope("K"))
    return product(_inserts(), step)


LETTERS = "dsuaoSUAO"


class Grammar:
    """Rules of Re-Pair in the order they were made, and a matrix for each symbol."""

    def __init__(self, rules: list[str] | None = None) -> None:
        self.rules: list[str] = []
        self.matrices = {letter: letter_matrix(letter) for letter in LETTERS}
        self.memo: dict[str, Matrix] = {}
        for pair in rules or []:
            self.add(pair)

    def add(self, pair: str) -> None:
        symbol = chr(FIRST_RULE + len(self.rules))
        self.rules.append(pair)
        self.matrices[symbol] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def compress(self, text: str) -> str:
        for n, pair in enumerate(self.rules):
            text = text.replace(pair, chr(FIRST_RULE + n))
        return text

    def matrix(self, letters: str) -> Matrix:
        if letters not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = None
            for symbol in self.compress(letters):
                found = self.matrices[symbol] if found is None else product(found, self.matrices[symbol])
            self.memo[letters] = found or identity()
        return self.memo[letters]


def pair_counts(text: str) -> Counter:
    """How often each pair of neighbours can be replaced in ``text``, whose strings end with a line end."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(codes) < 2:
        return Counter()
    end = ord("\n")
    inside = (codes[:-1] != end) & (codes[1:] != end)
    keys, many = np.unique((codes[:-1] << np.uint64(32) | codes[1:])[inside], return_counts=True)
    counts: Counter = Counter()
    for key, count in zip(keys.tolist(), many.tolist(), strict=True):
        pair = chr(key >> 32) + chr(key & 0xFFFFFFFF)
        counts[pair] = text.count(pair) if pair[0] == pair[1] else count
    return counts


def learn_grammar(strings: DataFrame) -> list[str]:
    """Rules for the column symbols of ``strings``, from counts over all of them.

    A round counts all pairs and replaces the most frequent ones that share no symbol, down to a quarter of the first;
    it ends when no pair occurs twice. What is left unpaired costs a product per symbol and changes no result.
    """
    rules: list[str] = []
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], rules: list[str] = list(rules)) -> Iterator[pa.RecordBatch]:
            grammar = Grammar()
            grammar.rules = rules
            counts: Counter = Counter()
            for batch in batches:
                counts.update(pair_counts(grammar.compress("\n".join(batch.column(0).to_pylist()) + "\n")))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "many"])

        counted = strings.select("symbols").mapInArrow(run, "pair string, many long")
        best = counted.groupBy("pair").agg(F.sum("many").alias("many")).orderBy(F.desc("many"), "pair").limit(PAIRS).collect()
        if not best or best[0].many < 2:
            break
        used: set[str] = set()
        for row in best:
            if row.many >= max(2, best[0].many / 4) and used.isdisjoint(row.pair):
                used.update(row.pair)
                rules.append(row.pair)
    return rules


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, gone) of ``conversations`` with faults planted by crc32(conv_id:turn) % 20.

    0 drops a row (gone), 1 empties its text, 2 takes out its [.!?], 3 repeats it (copy 1), 4 makes it the user's. A null
    role or text is one space, and so is a null in the text that is hashed.
    """
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    named = F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = (F.crc32(named) % 20).alias("kind")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"), kind)
    rows = rows.select("*", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        "copy",
        (F.col("kind") == 0).alias("gone"),
    )


def _plain(turns: DataFrame) -> DataFrame:
    """``turns`` with the columns of ``damage``, and the keys of its order: the conversation, then the turn."""
    has = set(turns.columns)
    blank = F.lit(" ")
    return turns.select(
        F.col("conv_id").isNotNull().alias("known"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), blank).alias("role"),
        F.coalesce(F.col("text").cast("string"), blank).alias("text"),
        (F.col("copy") if "copy" in has else F.lit(0)).cast("int").alias("copy"),
        (F.col("gone") if "gone" in has else F.lit(False)).alias("gone"),
    )


def _key() -> Column:
    """32 bytes that name the role and the text."""
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256))


#: The order of a conversation: by turn, nulls first; rows of one turn by role and by the digest of their text.
ORDER = ["known", "conv", "turn", "role", "key", "copy"]


def _rows_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "V32")


def _mark_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``repeat``: whether an earlier row of the conversation has the same role and text.

    Sorted by conversation, text and turn over all tasks, a row is a repeat if the row before it is alike; only the first
    row of each partition has to ask the last one of an earlier partition.
    """
    order = ["known", "conv", "key", "turn", "copy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = task_name()[0]
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            known, conv, keys = batch["known"].to_numpy(zero_copy_only=False), batch["conv"].to_numpy(), _rows_of(batch["key"])
            alike = np.r_[False, (known[1:] == known[:-1]) & (conv[1:] == conv[:-1]) & (keys[1:] == keys[:-1])]
            now = (bool(known[0]), int(conv[0]), keys[0].tobytes())
            alike[0] = last == now
            head = np.zeros(len(conv), bool)
            head[0] = last is None
            last = (bool(known[-1]), int(conv[-1]), keys[-1].tobytes())
            arrays = [*batch.columns, pa.array(alike), pa.array(head), pa.array(np.full(len(conv), part, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "repeat", "head", "part"])

    shape = rows.schema.simpleString()[7:-1].replace(":", " ")
    dealt = rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    marked = written(dealt.mapInArrow(run, f"{shape}, repeat boolean, head boolean, part int"), "repeats")
    # Two rows a partition: its first, and its last by the same order.
    name = F.struct("known", "conv", "key")
    ends = marked.groupBy("part").agg(F.min(name).alias("first"), F.max(name).alias("last")).orderBy("part").collect()
    late = [b.part for a, b in zip(ends, ends[1:], strict=False) if a["last"] == b["first"]]
    return marked.withColumn("repeat", F.col("repeat") | F.col("head") & F.col("part").isin(late)).drop("head", "part")


FIGURES = ["blank", "duplicate", "truncated", "illegal", "distinct"]
BLOCKS = (
    "known boolean, conv long, place long, symbols string, blank long, duplicate long, truncated long, illegal long, distinct long, "
    "low long, high long, first_turn long, last_turn long, first string, last string"
)
LEGAL = ("su", "ua", "au")


def _blocks(rows: DataFrame) -> DataFrame:
    """Strings of up to ``BLOCK`` letters, each with its figures and what its neighbours need of its ends."""
    names = [field.split()[0] for field in BLOCKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = task_name()[0] << 40
        block: dict | None = None
        letters: list[str] = []
        out: list[dict] = []

        def close() -> None:
            if block is not None:
                out.append({**block, "symbols": "".join(letters)})

        for batch in batches:
            columns = [batch[name].to_pylist() for name in ("known", "conv", "turn", "initial", "gone", "blank", "cut", "repeat")]
            for known, conv, turn, initial, gone, blank, cut, repeat in zip(*columns, strict=True):
                if block is None or (known, conv) != (block["known"], block["conv"]) or len(letters) >= BLOCK:
                    close()
                    block = {**dict.fromkeys(names), **dict.fromkeys(FIGURES, 0), "known": known, "conv": conv, "place": place}
                    letters = []
                    place += 1
                if gone:
                    continue
                initial = initial if initial and initial in "sua" else OTHER
                fault = "blank" if blank else "duplicate" if repeat else "truncated" if cut else None
                if fault:
                    block[fault] += 1
                if letters:
                    block["illegal"] += block["last"] + initial not in LEGAL
                else:
                    block["first"], block["first_turn"] = initial, turn
                if turn is not None:
                    block["distinct"] += turn != block["high"]
                    block["low"], block["high"] = turn if block["low"] is None else block["low"], turn
                block["last"], block["last_turn"] = initial, turn
                letters.append(DELETE if blank or repeat else initial.upper() if cut else initial)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in BLOCKS.split(", "))])
    columns = [c for c in ORDER if c != "role"] + ["role", "initial", "gone", "blank", "cut", "repeat"]
    dealt = rows.select(*columns).repartitionByRange(parts(rows.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    return written(dealt.select("known", "conv", "turn", "initial", "gone", "blank", "cut", "repeat").mapInArrow(run, BLOCKS), "blocks")


def _stored(matrix: Matrix) -> dict:
    cells = [cell for row in matrix for cell in row]
    return {"costs": [None if c is None else c[0] for c in cells], "edits": [None if c is None else str(c[1]) for c in cells]}


def _loaded(row: dict) -> Matrix:
    cells = [None if cost is None else (cost, Rope(edits)) for cost, edits in zip(row["costs"], row["edits"], strict=True)]
    return [cells[i : i + STATES] for i in range(0, len(cells), STATES)]


def _joined(a: dict, b: dict) -> dict:
    """Two neighbouring strings of one conversation as one."""
    if a["first"] is None or b["first"] is None:
        return {**(a if b["first"] is None else b), "place": a["place"]}
    both = {**a, **{name: a[name] + b[name] for name in FIGURES}}
    both["illegal"] += a["last"] + b["first"] not in LEGAL
    # turns ascend, so a turn that both hold is the last of one and the first not null of the other
    both["distinct"] -= a["high"] is not None and a["high"] == b["low"]
    both["low"] = b["low"] if a["low"] is None else a["low"]
    both["high"] = a["high"] if b["high"] is None else b["high"]
    both |= {"last": b["last"], "last_turn": b["last_turn"]}
    return {**both, **_stored(product(_loaded(a), _loaded(b)))}


def _results(blocks: DataFrame, rules: list[str]) -> DataFrame:
    """(known, conv, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation."""
    figures = [name for name in blocks.columns if name != "symbols"]
    shape = BLOCKS.replace("symbols string, ", "") + ", costs array<long>, edits array<string>"

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in batches:
            found = [_stored(grammar.matrix(letters)) for letters in batch["symbols"].to_pylist()]
            arrays = [batch[name] for name in figures]
            arrays += [pa.array([row["costs"] for row in found], pa.list_(pa.int64())), pa.array([row["edits"] for row in found], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*figures, "costs", "edits"])

    def multiply(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda row: row["place"])
        total = rows[0]
        for row in rows[1:]:
            total = _joined(total, row)
        return pa.Table.from_pylist([total], schema=group.schema).select(names)

    names = [*figures, "costs", "edits"]
    level = blocks.mapInArrow(evaluate, shape)
    whole = None
    while True:
        conv = Window.partitionBy("known", "conv")  # of strings, each with up to BLOCK rows
        counted = level.withColumn("many", F.count("*").over(conv)).withColumn("slot", F.floor((F.row_number().over(conv.orderBy("place")) - 1) / FAN))
        counted = written(counted, "strings")
        done = counted.where("many = 1").select(*names)
        whole = done if whole is None else whole.unionByName(done)
        several = counted.where("many > 1")
        if several.isEmpty():
            break
        level = several.select("slot", *names).groupBy("known", "conv", "slot").applyInArrow(multiply, shape)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).alias("gaps")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = _inserts()
        for batch in batches:
            best = []
            for costs, edits in zip(batch["costs"].to_pylist(), batch["edits"].to_pylist(), strict=True):
                start = [None if c is None else (c, Rope(e)) for c, e in zip(costs[:STATES], edits[:STATES], strict=True)]
                ends = [(start[k][0] + closing[k][j][0], start[k][1] + closing[k][j][1]) for k in range(STATES) for j in ENDS if start[k] and closing[k][j]]
                best.append(_least(ends))
            kept = [batch[name] for name in named]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for c, _ in best], pa.int64()), pa.array([str(e) for _, e in best], pa.string())], names=[*named, "cost", "audit"])

    named = ["known", "conv", "gaps", "blank", "duplicate", "truncated", "illegal"]
    rows = whole.select("known", "conv", gaps, "blank", "duplicate", "truncated", "illegal", "costs", "edits")
    out = "known boolean, conv long, " + ", ".join(f"{n} long" for n in named[2:]) + ", cost long, audit string"
    return written(rows.mapInArrow(finish, out), "results")


def analysed(turns: DataFrame) -> DataFrame:
    """(known, conv, gaps, blank, duplicate, truncated, illegal, cost, audit); conv is 0 where the id is not known."""
    rows = _plain(turns)
    last = F.substring(F.btrim("text", F.lit(SPACE)), -1, 1)
    narrow = rows.select(
        *["known", "conv", "turn", "role", _key().alias("key"), "copy", F.substring("role", 1, 1).alias("initial"), "gone"],
        (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("cut"),
    )
    narrow = written(narrow, "turns")
    fit = ~F.col("gone") & ~F.col("blank")  # others are no repeats and nothing repeats them
    unfit = narrow.where(~fit).withColumn("repeat", F.lit(False))
    marked = _mark_repeats(narrow.where(fit)).unionByName(unfit)
    blocks = _blocks(marked)
    return _results(blocks, learn_grammar(blocks))


class Editor:
    """Walks a conversation's edits along its turns."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def _next_role(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = 3 if self.state == 2 else 2
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The turns inserted here."""
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next_role(), ""

    def turn(self, role: str, text: str) -> tuple[str, str] | None:
        """What becomes of the next turn."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return None
        if edit == "R":
            return self._next_role(), text
        self.state = {"s": 1, "u": 2, "a": 3}[role[0]]
        return role, text


def _walk(turns: DataFrame, results: DataFrame) -> DataFrame:
    """The turns of each conversation in order after a row (rank 0) with its results, each conversation in one partition.

    Nothing but the order needs the turns of a conversation together; readers see them as a stream.
    """
    rows = _plain(turns).where(~F.col("gone")).withColumn("key", _key()).withColumn("rank", F.lit(1)).drop("gone")
    heads = results.withColumn("rank", F.lit(0))
    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition(parts(turns.sparkSession), "known", "conv").sortWithinPartitions("known", "conv", "rank", "turn", "role", "key", "copy")


def repair_report(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    ``turns``: conv_id, turn, role, text, and optionally copy and gone (see ``damage``). Null roles and texts are one space.
    Rows of one turn are ordered by role, the sha256 of role and text, and copy. A null conv_id is a conversation of its
    own. A conversation whose rows are all gone has zeros, no edits and the hash of an empty text; a table without rows
    gives none. Other columns are not read. The hash over a conversation's texts can only be taken in order, so these pass one
    task as a stream; all else is spread over tasks, however long the conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = editor = digest = None
        out: list[dict] = []

        def add(lines: Iterable[tuple[str, str]]) -> None:
            nonlocal first
            for role, text in lines:
                digest.update(("" if first else "\n").encode() + role.encode() + b":" + text.encode())
                first = False

        def close() -> None:
            if head is not None:
                add(editor.inserted())
                out.append({**head, "repaired_sha256": digest.hexdigest()})

        first = True
        for batch in batches:
            for row in batch.to_pylist():
                if row["rank"] == 0:
                    close()
                    head = {"conv_id": row["conv"] if row["known"] else None, **{name: row[name] for name in names[1:-1]}}
                    editor, digest, first = Editor(row["audit"]), hashlib.sha256(), True
                    continue
                add(editor.inserted())
                kept = editor.turn(row["role"], row["text"])
                if kept:
                    add([kept])
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        close()
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(name, pa.string() if name in ("audit", "repaired_sha256") else pa.int64()) for name in names])
    shape = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)
    return _walk(turns, analysed(turns)).mapInArrow(run, shape)


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, edit): the turns of the repaired conversations in order; inserted ones have no turn.

    Rows and orders count as in ``repair_report``; a conversation that loses all turns has no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, conv, place = None, None, 0
        for batch in batches:
            out: list[tuple] = []

            def add(turn: int | None, role: str, text: str, edit: str) -> None:
                nonlocal place
                out.append((conv, place, turn, role, text, edit))  # noqa: B023
                place += 1

            for row in batch.to_pylist():
                if row["rank"] == 0:
                    for lines in editor.inserted() if editor else ():
                        add(None, *lines, "I")
                    editor, conv, place = Editor(row["audit"]), row["conv"] if row["known"] else None, 0
                    continue
                for lines in editor.inserted():
                    add(None, *lines, "I")
                edit = editor.audit[editor.at]
                kept = editor.turn(row["role"], row["text"])
                if kept:
                    add(row["turn"], *kept, edit)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row, strict=True)) for row in out], schema=schema)
        if editor:
            rows = [dict(zip(schema.names, (conv, place + n, None, *lines, "I"), strict=True)) for n, lines in enumerate(editor.inserted())]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    kinds = {"conv_id": pa.int64(), "place": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}
    schema = pa.schema(list(kinds.items()))
    return _walk(turns, analysed(turns)).mapInArrow(run, "conv_id long, place long, turn long, role string, text string, edit string")
