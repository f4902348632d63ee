"""Chat formatting: roles of a transcript by a hidden Markov model, then canonical turns.

A line is in one of six states: first or further line of a system, user or assistant turn. It shows a *speaker marker* (``User:``,
``### Assistant``, ``<|system|>``, ``[Human]``, ``**Bot**:`` and the like, or a name that is no known role) and *line features* (a blank
line before it, a question mark at its end, its length class). Transitions, markers and features are counted on labelled
conversations, with pseudo-counts; Viterbi decoding gives the most probable states of all lines together, so unmarked or
oddly named speakers get the role that fits the turns around them.

Long conversations are decoded exactly without being gathered: pieces of ``PIECE`` turns are summed up as best scores from each state before a piece
to each state at its end, these are combined ``FAN`` at a time until one is left, the best path is traced back through them, and each piece is
decoded between the two states that the path has at its ends.

Defined results: a null or empty text is a turn without text; a null or unknown role in ``conversations`` is a turn without a marker; rows
with equal turn numbers are ordered by role and text, null turn numbers come first; a null ``conv_id`` is a conversation of its own; a text of any
length is one turn; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import materialise, n_partitions

ROLES = ("system", "user", "assistant")
#: Turns in a piece, and pieces (or sums of pieces) combined at once.
PIECE = 128
FAN = 256
#: The state before the first line of a conversation.
BEGIN = 6
_ALIASES = {
    "system": ("system", "sys", "instruction", "instructions", "context", "developer"),
    "user": ("user", "human", "you", "me", "customer", "client", "question", "q", "prompter", "inst"),
    "assistant": ("assistant", "ai", "bot", "gpt", "chatgpt", "model", "agent", "answer", "a", "response", "chatbot"),
}
_ROLE_OF = {alias: role for role, names in _ALIASES.items() for alias in names}
_MARK = re.compile(
    r"^[ \t]*(?:<\|(?:im_start\|>)?[ \t]*(?P<a>[A-Za-z]{1,20})(?:\|>)?|\[(?P<b>[A-Za-z]{1,20})\][ \t]*:?|#{1,4}[ \t]*(?P<c>[A-Za-z]{1,20})[ \t]*:?(?=[ \t]*$)"
    r"|\*{1,2}(?P<d>[A-Za-z]{1,20})[ \t]*:?\*{1,2}[ \t]*:?|(?P<e>[A-Za-z]{1,20})[ \t]*(?:\(\w{1,20}\)[ \t]*)?[:>])[ \t]?"
)
MARKS = ("none", "name", *ROLES)
FEATURES = ("gap", "question", "length")
#: Pseudo-counts that are not 1: who begins, that speakers take turns, that a first line has its role's marker or a bare name and a further line none.
_PRIOR = {
    ("start", "user"): 3.0,
    ("start", "assistant"): 0.3,
    **{("next", r, r): 0.2 for r in ROLES},
    **{("more", r): 6.0 for r in ROLES},
    ("next", "system", "user"): 8.0,
    ("next", "user", "assistant"): 8.0,
    ("next", "assistant", "user"): 8.0,
    **{("mark", r, True, m): 9.0 if m == r else {"none": 0.3, "name": 0.7}.get(m, 0.01) for r in ROLES for m in MARKS},
    **{("mark", r, False, m): {"none": 9.8, "name": 0.12}.get(m, 0.01) for r in ROLES for m in MARKS},
    **{("gap", r, False, 0): 3.0 for r in ROLES},
}
STATES = tuple((r, first) for r in ROLES for first in (True, False))


def marker(line: str) -> tuple[str, str]:
    """(mark, rest of the line)."""
    m = _MARK.match(line)
    if not m:
        return "none", line
    name = next(x for x in m.groups() if x).lower()
    role = _ROLE_OF.get(name)
    if role is None and (m["e"] is None or not line.lstrip()[:1].isupper()):
        return "none", line
    return role or "name", line[m.end() :]


def features(line: str, after_blank: bool) -> tuple[int, int, int]:
    return int(after_blank), int(line.rstrip().endswith("?")), min(3, len(line).bit_length() // 3)


class Model:
    """Log probabilities of starts, transitions, markers and line features."""

    def __init__(self, counts: dict[tuple, float] | None = None):
        counts = counts or {}
        look = lambda *key: counts.get(key, 0.0) + _PRIOR.get(key, 1.0)
        log = lambda own, total: math.log(own / total)
        starts = {r: look("start", r) for r in ROLES}
        total = sum(starts.values())
        self.start = [log(starts[r], total) if first else -math.inf for r, first in STATES]
        self.anywhere = [math.log(1 / len(ROLES)) if first else -math.inf for _, first in STATES]
        self.trans = []
        for r, _ in STATES:
            more = look("more", r)
            nexts = {q: look("next", r, q) for q in ROLES}
            whole = more + sum(nexts.values())
            self.trans.append([log(nexts[q], whole) if first else log(more, whole) if q == r else -math.inf for q, first in STATES])
        self.mark = []
        for r, first in STATES:
            seen = {m: look("mark", r, first, m) for m in MARKS}
            self.mark.append({m: log(x, sum(seen.values())) for m, x in seen.items()})
        self.feature = []
        for r, first in STATES:
            sets = []
            for name, values in zip(FEATURES, (2, 2, 4), strict=True):
                seen = [look(name, r, first, v) for v in range(values)]
                sets.append([log(x, sum(seen)) for x in seen])
            self.feature.append(sets)

    def emissions(self, lines: list[str], marks: list[tuple[str, str]], after_blank: bool = False) -> list[list[float]]:
        """For each line the log probability of its marker and features in each state."""
        out = []
        for i, (mark, rest) in enumerate(marks):
            f = features(rest, not lines[i - 1].strip() if i else after_blank)
            out.append([m[mark] + sum(s[v] for s, v in zip(sets, f, strict=True)) for m, sets in zip(self.mark, self.feature, strict=True)])
        return out

    def first(self, entry: int) -> list[float]:
        """Scores of the first line's states after the state ``entry``."""
        return self.start if entry == BEGIN else self.trans[entry]

    def transfer(self, lines: list[str], after_blank: bool) -> list[list[float]]:
        """Best score from each state before the lines (the last: the beginning) to each state of the last line."""
        emit = self.emissions(lines, [marker(x) for x in lines], after_blank)
        rows = []
        for entry in range(len(STATES) + 1):
            score = [a + e for a, e in zip(self.first(entry), emit[0], strict=True)]
            for own in emit[1:]:
                score = [max(score[q] + self.trans[q][s] for q in range(len(STATES))) + own[s] for s in range(len(STATES))]
            rows.append(score)
        return rows

    def decode(self, lines: list[str], entry: int = BEGIN, leave: int | None = None, after_blank: bool = False) -> list[tuple[str, bool, str]]:
        """(role, first line of a turn, text without marker) for each line, between the states before the lines and of the last (any, if None)."""
        if not lines:
            return []
        marks = [marker(x) for x in lines]
        emit = self.emissions(lines, marks, after_blank)
        score, back = [a + e for a, e in zip(self.first(entry), emit[0], strict=True)], []
        for own in emit[1:]:
            step, now = [], []
            for s in range(len(STATES)):
                p = max(range(len(STATES)), key=lambda q: score[q] + self.trans[q][s])  # noqa: B023
                step.append(p)
                now.append(score[p] + self.trans[p][s] + own[s])
            back.append(step)
            score = now
        at = max(range(len(STATES)), key=score.__getitem__) if leave is None else leave
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        out = []
        for s, line, (mark, rest) in zip(reversed(path), lines, marks, strict=True):
            role, first = STATES[s]
            out.append((role, first, rest if first and mark != "none" else line))
        return out


def turns(transcript: str, model: Model, entry: int = BEGIN, leave: int | None = None, after_blank: bool = False) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript or of a piece of one, whose first turn may go on from before."""
    out: list[tuple[str, list[str]]] = []
    lines = transcript.split("\n")
    for line, (role, first, text) in zip(lines, model.decode(lines, entry, leave, after_blank), strict=True):
        if first or not out:
            alone = not text and line and not line.rstrip(" \t").endswith((":", ">")) or line.rstrip().endswith("|>")
            out.append((role, [] if alone and not text else [text]))
        else:
            out[-1][1].append(text)
    return [(r, "\n".join(t)) for r, t in out]


def render(role: str, text: str) -> str:
    """The canonical form of a turn."""
    return f"<|{role}|>\n{text}\n<|end|>"


def learned_from() -> Column:
    """Conversations that the model is fitted on; the others only have their roles recovered."""
    return F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 != 2, F.lit(True))


def fit(turns: DataFrame) -> Model:
    """Count starts, transitions, markers and line features over labelled ``turns(conv_id, turn, role, text, line)``, ``line`` being the text as the transcript
    has it, marker included; the result has some dozen numbers."""
    src = turns.where(F.col("role").isin(*ROLES))
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    blank = F.col("text").rlike("(?:^|\\n)[ \\t]*$").cast("int")
    seq = src.select("role", F.lag("role").over(w).alias("before"), F.lag(blank).over(w).alias("gap"))
    counts: dict[tuple, float] = {}
    for r in seq.groupBy("before", "role", "gap").count().collect():
        own = ("start", r["role"]) if r["before"] is None else ("next", r["before"], r["role"])
        counts[own] = counts.get(own, 0.0) + r["count"]
        if r["gap"] is not None:
            own = ("gap", r["role"], True, r["gap"])
            counts[own] = counts.get(own, 0.0) + r["count"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        seen: dict[tuple, int] = {}
        for batch in batches:
            for role, text in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                lines = text.split("\n")
                first = 1 if not marker(lines[0])[1] and len(lines) > 1 and marker(lines[0])[0] != "none" else 0  # a marker on a line of its own
                for i, line in enumerate(lines):
                    mark, rest = marker(line)
                    gap, question, length = features(rest, i > 0 and not lines[i - 1].strip())
                    is_first = i == 0
                    own = [("mark", mark, -1), ("question", "", question), ("length", "", length)] if i != first or not first else [("mark", mark, -1)]
                    for name, m, v in own + ([] if is_first else [("gap", "", gap), ("more", "", -1)]):
                        key = (name, role, is_first, m, v)
                        seen[key] = seen.get(key, 0) + 1
        if seen:
            cols = [*zip(*seen, strict=True), list(seen.values())]
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["name", "role", "first", "mark", "value", "n"])

    told = src.select("role", "line").mapInArrow(run, "name string, role string, first boolean, mark string, value long, n long")
    for r in told.groupBy("name", "role", "first", "mark", "value").agg(F.sum("n").alias("n")).collect():
        own = ("more", r["role"]) if r["name"] == "more" else (r["name"], r["role"], r["first"], r["mark"] if r["name"] == "mark" else r["value"])
        counts[own] = counts.get(own, 0.0) + r["n"]
    return Model(counts)


def marked(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, line`` of every turn as a transcript has it: each conversation in one of four styles of speaker markers, every third turn
    with a bare name in place of its role, a turn without a known role without any."""
    role, text = F.lower(F.trim("role")), F.coalesce("text", F.lit(""))
    style = F.coalesce(F.pmod(F.xxhash64("conv_id"), F.lit(4)), F.lit(0))
    title = F.initcap(role)
    plain = F.when(style == 0, F.concat(title, F.lit(": "), text)).when(style == 1, F.concat(F.lit("["), F.upper(role), F.lit("] "), text)).when(style == 2, F.concat(F.lit("**"), title, F.lit("**: "), text))
    line = plain.otherwise(F.concat(F.lit("<|"), role, F.lit("|> "), text))
    renamed = F.coalesce((F.col("turn") > 0) & (F.pmod(F.xxhash64("conv_id") + F.col("turn"), F.lit(3)) == 0), F.lit(False))
    line = F.when(renamed, F.concat(F.lit("Robin: "), text)).otherwise(line)
    known = F.coalesce(role.isin(*ROLES), F.lit(False))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(known, line).otherwise(F.concat(F.lit("\n"), text)).alias("line"))


def pieces_of(turns: DataFrame) -> DataFrame:
    """``conv_id, ord, transcript, blank``: conversations in order, cut into pieces of ``PIECE`` turns; ``blank`` tells whether the last line is.

    Rows are dealt out by ranges of conversation and turn, so a common conversation is spread over many tasks, and each task only streams.
    """
    schema = T.StructType([turns.schema["conv_id"], *[T.StructField(c, t) for c, t in (("ord", T.LongType()), ("transcript", T.StringType()), ("blank", T.BooleanType()))]])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId() << 40, 0
        kind, out, now, held = None, [], None, []

        def close():
            nonlocal seq, held
            if held:
                out.append((now, part + seq, "\n".join(held), not held[-1].rsplit("\n", 1)[-1].strip()))
                seq += 1
                held = []

        for batch in batches:
            kind = batch.schema.field(0).type
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv != now or len(held) >= PIECE:
                    close()
                    now = conv
                held.append(line)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, pa.int64(), pa.string(), pa.bool_()], strict=True)], names=schema.names)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [kind, pa.int64(), pa.string(), pa.bool_()], strict=True)], names=schema.names)

    start = F.substring("text", 1, 16)
    ranged = turns.repartitionByRange(n_partitions(turns.sparkSession), F.col("conv_id"), F.col("turn"), F.col("role"), start)
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "line").mapInArrow(run, schema)


_SUM = "i long, m0 array<double>, m1 array<double>, blank boolean"


def _product(a: list, b: list) -> list:
    """Best scores through two stretches one after the other: 7 x 6 by 6 x 6, as flat lists."""
    n = len(STATES)
    return [max(a[r * n + q] + b[q * n + s] for q in range(n)) for r in range(n + 1) for s in range(n)]


def _summed(level: DataFrame) -> DataFrame:
    """Stretches of one conversation combined, ``FAN`` at a time."""
    kind = level.schema["conv_id"].dataType.simpleString()

    def run(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        both = []
        for own in ("m0", "m1"):
            m, blank = rows[0][own], rows[0]["blank"]
            for r in rows[1:]:
                m, blank = _product(m, r["m1"] if blank else r["m0"]), r["blank"]
            both.append(m)
        return pa.Table.from_pylist(
            [{"conv_id": rows[0]["conv_id"], "i": rows[0]["up"], "m0": both[0], "m1": both[1], "blank": rows[-1]["blank"]}],
            schema=pa.schema([table.schema.field("conv_id"), ("i", pa.int64()), ("m0", pa.list_(pa.float64())), ("m1", pa.list_(pa.float64())), ("blank", pa.bool_())]),
        )

    return level.withColumn("up", F.floor(F.col("i") / FAN)).groupBy("conv_id", "up").applyInArrow(run, f"conv_id {kind}, {_SUM}")


def _traced(level: DataFrame, ends: DataFrame | None) -> DataFrame:
    """``conv_id, i, entry, leave, after``: the states of the best path at both ends of each stretch, given those of the stretches of the level above."""
    kind = level.schema["conv_id"].dataType.simpleString()
    rows = level.withColumn("up", F.floor(F.col("i") / FAN))
    if ends is None:
        rows = rows.withColumns({"entry": F.lit(BEGIN), "leave": F.lit(-1), "after": F.lit(False)})
    else:
        up = ends.select(F.col("conv_id").alias("_c"), F.col("i").alias("_up"), "entry", "leave", "after")
        rows = rows.join(up, F.expr("conv_id <=> _c and up = _up")).drop("_c", "_up")

    def run(key, table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["i"])
        n, entry, blank = len(STATES), rows[0]["entry"], rows[0]["after"]
        score, back, flags = None, [], []
        for r in rows:
            m = r["m1"] if blank else r["m0"]
            flags.append(blank)
            blank = r["blank"]
            if score is None:
                score = m[entry * n : entry * n + n]
                continue
            step = [max(range(n), key=lambda q: score[q] + m[q * n + s]) for s in range(n)]  # noqa: B023
            score = [score[q] + m[q * n + s] for s, q in enumerate(step)]
            back.append(step)
        at = rows[0]["leave"] if rows[0]["leave"] >= 0 else max(range(n), key=score.__getitem__)
        leaves = [at]
        for step in reversed(back):
            at = step[at]
            leaves.append(at)
        leaves.reverse()
        out = [
            {"conv_id": r["conv_id"], "i": r["i"], "entry": entry if k == 0 else leaves[k - 1], "leave": leaves[k], "after": flags[k]}
            for k, r in enumerate(rows)
        ]
        return pa.Table.from_pylist(out, schema=pa.schema([table.schema.field("conv_id"), ("i", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32()), ("after", pa.bool_())]))

    return rows.groupBy("conv_id", "up").applyInArrow(run, f"conv_id {kind}, i long, entry int, leave int, after boolean")


def _path(pieces: DataFrame, model: Model) -> DataFrame:
    """``conv_id, ord, entry, leave, after`` of the pieces of conversations of several pieces."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            bodies = [(t or "").split("\n") for t in batch.column(2).to_pylist()]
            sums = [pa.array([[x for row in model.transfer(b, gap) for x in row] for b in bodies], pa.list_(pa.float64())) for gap in (False, True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sums, batch.column(3)], names=["conv_id", "i", "m0", "m1", "blank"])

    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("ord")) - 1
    numbered = materialise(pieces.select("conv_id", "ord", number.cast("long").alias("i")), "chat-pieces", light=True)
    placed = pieces.alias("p").join(numbered.alias("n"), F.expr("p.conv_id <=> n.conv_id and p.ord = n.ord")).select("p.conv_id", "n.i", "p.transcript", "p.blank")
    levels = [materialise(placed.mapInArrow(run, f"conv_id {kind}, {_SUM}"), "chat-level")]
    while levels[-1].agg(F.max("i")).first()[0]:
        levels.append(materialise(_summed(levels[-1]), "chat-level", light=True))
    ends = None
    for level in reversed(levels):
        ends = materialise(_traced(level, ends), "chat-ends", light=True)
    return numbered.alias("n").join(ends.alias("e"), F.expr("n.conv_id <=> e.conv_id and n.i = e.i")).select("n.conv_id", "n.ord", "e.entry", "e.leave", "e.after")


def parse_pieces(pieces: DataFrame, model: Model) -> DataFrame:
    """``conv_id, ord, n, role, text, more`` of the turns of pieces ``conv_id, ord, transcript, entry, leave, after``; ``more``: it goes on from the piece before."""
    schema = T.StructType(
        [pieces.schema["conv_id"], *[T.StructField(c, t) for c, t in (("ord", T.LongType()), ("n", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("more", T.BooleanType()))]]
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for conv, place, body, entry, leave, after in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                leave = None if leave is None or leave < 0 else leave
                found = turns(body or "", model, entry, leave, after)
                opens = model.decode((body or "").split("\n"), entry, leave, after)[0][1]
                rows += [(conv, place, n, role, text, n == 0 and not opens) for n, (role, text) in enumerate(found)]
            if rows:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    return pieces.select("conv_id", "ord", "transcript", "entry", "leave", "after").mapInArrow(run, schema)


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """``conv_id, turn_no, role, text, rendered``: recovered turns of every conversation, numbered from 0.

    Unless given, the model is fitted on the conversations of ``learned_from``.
    """
    said = marked(conversations)
    model = model or fit(said.where(learned_from()))
    pieces = materialise(pieces_of(said), "chat")
    several = pieces.groupBy("conv_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("conv_id").alias("_c"))
    several = materialise(several, "chat-long", light=True)
    alone = pieces.join(several, F.expr("conv_id <=> _c"), "left_anti").withColumns({"entry": F.lit(BEGIN), "leave": F.lit(-1), "after": F.lit(False)})
    if not several.isEmpty():
        long = pieces.join(several, F.expr("conv_id <=> _c"), "left_semi")
        ends = _path(long, model)
        joined = long.alias("p").join(ends.alias("e"), F.expr("p.conv_id <=> e.conv_id and p.ord = e.ord")).select("p.*", "e.entry", "e.leave", "e.after")
        alone = alone.unionByName(joined)
    parsed = materialise(parse_pieces(alone, model), "turns")
    sizes = parsed.groupBy("conv_id", "ord").agg(F.count_if(~F.col("more")).alias("c"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("conv_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # in a piece that begins with the rest of a turn, its first own turn is row 1
    own = parsed.where("more").select("conv_id", "ord", F.lit(1).alias("_late"))
    base = sizes.select("conv_id", "ord", before.alias("base")).alias("b").join(own.alias("o"), F.expr("b.conv_id <=> o.conv_id and b.ord = o.ord"), "left")
    base = base.select("b.conv_id", "b.ord", (F.col("base") - F.coalesce("_late", F.lit(0))).alias("base"))
    numbered = parsed.alias("p").join(base.alias("b"), F.expr("p.conv_id <=> b.conv_id and p.ord = b.ord")).select("p.conv_id", (F.col("base") + F.col("n")).alias("turn_no"), "p.ord", "p.role", "p.text", "p.more")
    rest = numbered.where("more").groupBy("conv_id", "turn_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("_rest"))
    whole = numbered.where("not more").alias("t").join(rest.alias("r"), F.expr("t.conv_id <=> r.conv_id and t.turn_no = r.turn_no"), "left")
    text = F.when(F.col("_rest").isNull(), F.col("t.text")).otherwise(F.concat_ws("\n", "t.text", "_rest"))
    out = whole.select("t.conv_id", "t.turn_no", "t.role", text.alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>")))
