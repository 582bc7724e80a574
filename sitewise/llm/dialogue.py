"""Repair of conversation structure by an automaton that shares the ends of all conversations.

Each row of a conversation becomes one letter for its role and fault, so a conversation is a word. Words
are sorted by their reverse, and equal endings lie next to each other: a node of the automaton is an
ending, built from the end, and words that end alike walk the same nodes. Every node holds, for each
state of the role grammar, the cost of the cheapest edits from there on and the ASCII-least edit string
of that cost; they are worked out once per node and state from the node behind it, whatever the number
of conversations that pass it (a node on the border of two sorted ranges is worked out in both).

Words have at most `CHUNK` letters. A longer conversation is cut into such chunks from its end; its
nodes keep the cost for each state at the chunk's end as well, and chunks are joined 64 at a time until
one is left. That is exact: insertions stand before a row or at the very end, so no cheapest edit
string of a chunk is the beginning of another one, and the least whole is made of least parts.

Grammar of the role initials: `(s?(ua)+)?`. Edits: Keep 0, Rerole to user or assistant 1, Delete 2
(the only choice for blank and repeated rows), Insert an empty row of user or assistant 5; a truncated
row that stays costs 5 more. Equal costs go to the ASCII-least edit string.

Edge cases. Null roles and texts count as one space; a null conversation id is a conversation. Rows are
ordered by turn, nulls first, then role, then text (its first 64 characters, then its SHA-256); equal rows
are repeats of each other. A role that starts with no s, u or a, the empty one included, is reroled or deleted.
Very long texts are only hashed. An empty table gives an empty report. Only the four columns are read,
so further columns can't clash. No conversation is ever collected: a group has at most 65 slim rows, and
the digest streams sorted rows. What is one value by contract, the edit string (a byte a row) and the
SHA-256 of a conversation, passes through one task per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sitewise.llm.common import null_safe_join
from sitewise.operators.ranking import ranked
from sitewise.operators.staging import write_and_read

CHUNK = 64
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
STATES = range(4)
START, SYSTEM, USER, ASSISTANT = STATES
#: Where a user or assistant row leads; the grammar allows one of the two in each state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAME = {USER: "user", ASSISTANT: "assistant"}
DELETE, REROLE, INSERT, KEPT_TRUNCATED = 2, 1, 5, 5
#: Cost and edits that end a conversation in each state: insertions until the grammar accepts.
ENDING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
BLANK = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"


# Letters ---------------------------------------------------------------------------------------------


def initial(role: Column) -> Column:
    """s, u, a, or x for any other first character."""
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("x")


def moves(letter: str) -> list[list[tuple[int, str, int]]]:
    """For each state the ways over one row: (cost, edits, state after). Up to two rows go in before it.

    `d` is a row that must go; else the letter is the role's, in upper case if the row is truncated.
    """
    ways: list[list[tuple[int, str, int]]] = []
    for state in STATES:
        own: dict[int, tuple[int, str]] = {}
        at, paid, done = state, 0, ""
        for _ in range(3):
            found = [(DELETE, "D", at)]
            if letter != "d":
                stays = KEPT_TRUNCATED if letter.isupper() else 0
                role = letter.lower()
                if role == "s" and at == START:
                    found.append((stays, "K", SYSTEM))
                if role == ("a" if at == USER else "u"):
                    found.append((stays, "K", NEXT[at]))
                found.append((stays + REROLE, "R", NEXT[at]))
            for cost, edit, to in found:
                way = (paid + cost, done + edit)
                own[to] = min(own.get(to, way), way)
            at, paid, done = NEXT[at], paid + INSERT, done + "I"
        ways.append([(cost, edits, to) for to, (cost, edits) in own.items()])
    return ways


MOVES = {letter: moves(letter) for letter in "suaxSUAXd"}

# Nodes -----------------------------------------------------------------------------------------------

#: node[state][exit]: cheapest (cost, edits) from `state` before the ending to `exit` after it, or None.
Node = list[list[tuple[int, str] | None]]
LEAF: Node = [[(0, "") if a == b else None for b in STATES] for a in STATES]


def before(letter: str, behind: Node) -> Node:
    """The node that reads `letter` and goes on as `behind`."""
    out: Node = []
    for ways in MOVES[letter]:
        row: list[tuple[int, str] | None] = [None] * len(STATES)
        for cost, edits, to in ways:
            for end, rest in enumerate(behind[to]):
                if rest is not None:
                    whole = (cost + rest[0], edits + rest[1])
                    if row[end] is None or whole < row[end]:
                        row[end] = whole
        out.append(row)
    return out


def joined(first: Node, second: Node) -> Node:
    """Two chunks in a row as one."""
    out: Node = []
    for row in first:
        made: list[tuple[int, str] | None] = [None] * len(STATES)
        for mid, head in enumerate(row):
            if head is None:
                continue
            for end, tail in enumerate(second[mid]):
                if tail is not None:
                    whole = (head[0] + tail[0], head[1] + tail[1])
                    if made[end] is None or whole < made[end]:
                        made[end] = whole
        out.append(made)
    return out


class Endings:
    """The automaton along a stream of words that is sorted by the reversed word.

    Only the nodes of the last word are held: the next word shares the longest common ending with it, as
    all words between two words that share an ending share it too.
    """

    def __init__(self) -> None:
        self.word, self.nodes, self.made = "", [LEAF], 0

    def node(self, reverse: str) -> Node:
        shared = len(commonprefix([self.word, reverse]))
        del self.nodes[shared + 1 :]
        for letter in reverse[shared:]:
            self.nodes.append(before(letter, self.nodes[-1]))
        self.made += len(reverse) - shared
        self.word = reverse
        return self.nodes[-1]


def best(node: Node) -> tuple[int, str]:
    """Cheapest (cost, edits) of a whole conversation."""
    return min((c + ENDING[q][0], e + ENDING[q][1]) for q, way in enumerate(node[START]) if way for c, e in [way])


# Tables ----------------------------------------------------------------------------------------------

_NODE = "costs array<bigint>, edits array<string>"


def _flat(node: Node) -> tuple[list[int], list[str]]:
    ways = [way or (-1, "") for row in node for way in row]
    return [c for c, _ in ways], [e for _, e in ways]


def _unflat(costs: list[int], edits: list[str]) -> Node:
    ways = [(c, e) if c >= 0 else None for c, e in zip(costs, edits)]
    return [ways[i : i + len(STATES)] for i in range(0, len(ways), len(STATES))]


def _id(df: DataFrame) -> StructField:
    return StructField("conv_id", df.schema["conv_id"].dataType)


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def damage(df: DataFrame) -> DataFrame:
    """Rows with the faults of the test: crc32 of `conv_id:turn` modulo 20 drops, empties, opens, repeats or reroles."""
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    text = F.when(F.col("f") == 1, "").when(F.col("f") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("f") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumn("f", fault).where("f <> 0").withColumn("text", text).withColumn("role", role)
    return rows.withColumn("f", F.explode(F.when(F.col("f") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("f")


def placed_rows(df: DataFrame) -> DataFrame:
    """Rows with `h`, the digest of the text, and `pos`, counted from the end of the conversation."""
    rows = df.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("h", F.sha2("text", 256))
    order = [F.col("turn").desc_nulls_last(), F.col("role").desc(), F.substring("text", 1, 64).desc(), F.col("h").desc()]
    return ranked(rows, ["conv_id"], order, "pos")


def chunk_words(placed: DataFrame) -> DataFrame:
    """One row per conversation and chunk: the word, and counts of faults and illegal neighbours."""
    open_end = ~F.col("text").rlike(CLOSED)
    slim = placed.select(
        "conv_id", "role", "h", "pos", initial(F.col("role")).alias("r"), (~F.col("text").rlike(BLANK)).alias("blank"), open_end.alias("open")
    )
    # The row of a group that stands first; equal rows are reduced before the shuffle.
    firsts = slim.groupBy("conv_id", "role", "h").agg(F.max("pos").alias("pos")).select("conv_id", "pos", F.lit(True).alias("new"))
    faults = null_safe_join(slim.drop("role", "h"), firsts, ["conv_id", "pos"], "left")
    fault = F.when(F.col("blank"), "b").when(F.col("new").isNull(), "d").when(F.col("open"), "t").otherwise("k")
    letter = F.when(F.col("f").isin("b", "d"), "d").when(F.col("f") == "t", F.upper("r")).otherwise(F.col("r"))
    chunk = F.floor(F.col("pos") / CHUNK)
    # The first row of a chunk is also told to the chunk before it, for the pair of neighbours across the cut.
    told = F.explode(F.when(F.col("pos") % CHUNK == CHUNK - 1, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    rows = faults.withColumn("f", fault).select("conv_id", told.alias("chunk"), "pos", "r", "f", letter.alias("letter"))
    own = F.floor(F.col("pos") / CHUNK) == F.col("chunk")
    lists = rows.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "r", F.when(own, F.col("letter")).otherwise("").alias("letter"))), False).alias("l"),
        *[F.sum((own & (F.col("f") == f)).cast("long")).alias(n) for f, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))],
    )
    word = F.array_join(F.col("l.letter"), "")
    roles = F.array_join(F.col("l.r"), "")
    illegal = F.length(roles) - 1 - F.regexp_count(roles, F.lit("(?=su|ua|au)"))
    made = lists.select("conv_id", "chunk", word.alias("word"), illegal.cast("long").alias("illegal"), "blank", "duplicate", "truncated")
    return write_and_read(made.where("word <> ''"), "words")


def chunk_nodes(words: DataFrame) -> DataFrame:
    """(conv_id, chunk, costs, edits): the node at which each word enters the automaton."""
    schema = StructType([_id(words), *StructType.fromDDL("chunk bigint, " + _NODE)])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        for batch in batches:
            made = [_flat(endings.node(r)) for r in batch.column("reverse").to_pylist()]
            lists = [batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist()]
            yield _batch([*lists, [c for c, _ in made], [e for _, e in made]], arrow)

    order = ["reverse", "conv_id", "chunk"]
    rows = words.select(F.reverse("word").alias("reverse"), "conv_id", "chunk")
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def join_chunks(nodes: DataFrame) -> DataFrame:
    """64 neighbouring chunks become one."""
    schema = nodes.schema
    arrow = _arrow(schema)
    parts = F.sort_array(F.collect_list(F.struct("chunk", "costs", "edits")), False).alias("parts")
    grouped = nodes.groupBy("conv_id", F.floor(F.col("chunk") / CHUNK).alias("chunk")).agg(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for parts in batch.column("parts"):
                node = LEAF
                for part in parts.as_py():
                    node = joined(node, _unflat(part["costs"], part["edits"]))
                made.append(_flat(node))
            lists = [batch.column("conv_id").to_pylist(), batch.column("chunk").to_pylist()]
            yield _batch([*lists, [c for c, _ in made], [e for _, e in made]], arrow)

    return write_and_read(grouped.mapInArrow(run, schema), "chunks")


def solve(words: DataFrame) -> DataFrame:
    """(conv_id, cost, audit): the cheapest edits of each conversation that has rows."""
    nodes = write_and_read(chunk_nodes(words), "nodes")
    longest = nodes.agg(F.max("chunk")).first()[0] or 0
    while longest:
        nodes, longest = join_chunks(nodes), longest // CHUNK
    ways = [
        F.when(F.col("costs")[q] >= 0, F.struct((F.col("costs")[q] + c).alias("cost"), F.concat(F.col("edits")[q], F.lit(e)).alias("audit")))
        for q, (c, e) in ENDING.items()
    ]
    return nodes.select("conv_id", F.array_min(F.array(*ways)).alias("w")).select("conv_id", "w.cost", "w.audit")


def edit_rows(solved: DataFrame) -> DataFrame:
    """(conv_id, seq, edit, pos, role) of every row that is left: `role` is null where the row keeps its own.

    An odd number of rows starts with a system row, which only Keep can give; after it users and
    assistants take turns, so the edits tell every role. Inserted rows have a negative `pos`.
    """
    schema = StructType([_id(solved), *StructType.fromDDL("seq bigint, edit string, pos bigint, role string")])
    arrow = _arrow(schema)

    def listed(conv, audit: str) -> Iterator[tuple]:
        pos = len(audit) - audit.count("I")
        stay = len(audit) - audit.count("D")
        state, seq = (START if stay % 2 else ASSISTANT), 0
        for edit in audit:
            pos -= edit != "I"
            if edit == "D":
                continue
            state = SYSTEM if state == START else NEXT[state]
            yield conv, seq, edit, -1 - seq if edit == "I" else pos, NAME[state] if edit in "RI" else None
            seq += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for conv, audit in zip(batch.column("conv_id").to_pylist(), batch.column("audit").to_pylist()):
                for row in listed(conv, audit):
                    held.append(row)
                    if len(held) == 10_000:
                        yield _batch([list(c) for c in zip(*held)], arrow)
                        held = []
        if held:
            yield _batch([list(c) for c in zip(*held)], arrow)

    return solved.select("conv_id", "audit").mapInArrow(run, schema)


def repaired_rows(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired conversations: (conv_id, seq, edit, turn, role, text), inserted rows without turn and text."""
    rows = placed.select("conv_id", "pos", "turn", F.col("role").alias("own"), "text")
    made = null_safe_join(edit_rows(solved), rows, ["conv_id", "pos"], "left")
    return made.select(
        "conv_id", "seq", "edit", "turn", F.coalesce("role", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) over the lines `role:text`, streamed in order."""
    schema = StructType([_id(repaired), StructField("repaired_sha256", StructType.fromDDL("x string")["x"].dataType)])
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
                if digest is not None and conv == last:
                    digest.update(b"\n")
                else:
                    if digest is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = conv, hashlib.sha256()
                digest.update(line)
            if done:
                yield _batch([list(c) for c in zip(*done)], arrow)
        if digest is not None:
            yield _batch([[last], [digest.hexdigest()]], arrow)

    lines = repaired.select("conv_id", "seq", F.concat_ws(":", "role", "text").cast("binary").alias("line"))
    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "line").mapInArrow(run, schema)


def repair_report(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation of `originals` (or of `rows`): gaps, faults, cost, audit and digest."""
    placed = placed_rows(rows)
    words = chunk_words(placed)
    solved = write_and_read(solve(words), "solved")
    shas = digests(repaired_rows(placed, solved))
    turns = placed.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("turns")
    )
    counts = ("blank", "duplicate", "truncated", "illegal")
    ids = (rows if originals is None else originals).select("conv_id").distinct()
    pieces = [ids, turns, words.select("conv_id", *counts), solved, shas]
    whole = pieces[0]
    for piece in pieces[1:]:
        whole = whole.unionByName(piece, allowMissingColumns=True)
    # Every piece has few rows per conversation and they are added up before the shuffle.
    told = whole.groupBy("conv_id").agg(
        *[F.max(c).alias(c) for c in ("low", "high", "turns", "cost", "audit", "repaired_sha256")],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in counts],
    )
    wide = F.col("high").cast("decimal(20,0)") - F.col("low").cast("decimal(20,0)") + 1 - F.col("turns")
    gaps = F.when(wide.isNotNull(), F.least(wide, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")).otherwise(0)
    return told.select(
        "conv_id", gaps.alias("gaps"), *counts, F.coalesce("cost", F.lit(0).cast("long")).alias("cost"),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def repair(df: DataFrame) -> DataFrame:
    """The repaired conversations of a table, as rows; see `repaired_rows`."""
    placed = placed_rows(df)
    return repaired_rows(placed, write_and_read(solve(chunk_words(placed)), "solved"))
