"""Operator 7. Minimum-cost role repair and rendering of conversations.

A legal conversation is an optional system turn, then user and assistant turns in alternation, beginning with user and
ending with assistant. A dynamic program over this automaton reads the turns in order and chooses, for each, to keep
its role, to give it another, or to merge it into the turn before, and between turns to insert an empty one, at the
least total cost. The repaired turns are rendered with a chat template whose markers are made harmless where a text
contains them.

Scale: one shuffle that brings a conversation's turns together, then a narrow stage over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketry.llm import common

ROLES = ("system", "user", "assistant")
#: Which role may follow which; None is the start.
LEGAL = {(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
FINAL = "assistant"
#: Costs: another role for a turn, a turn merged into the one before (and relabelled to its role), an empty turn.
RELABEL, MERGE, INSERT = 3, 2, 4
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}

#: (action, role, number of the turn read or None)
Step = tuple[str, str, int | None]


def role(name: str | None) -> str | None:
    """The role that a name stands for; None if it stands for none."""
    low = (name or "").strip().lower()
    low = ALIASES.get(low, low)
    return low if low in ROLES else None


def repair(roles: Sequence[str | None]) -> tuple[int, list[Step]]:
    """The least cost, and its steps: keep or relabel a turn, merge it into the turn before, insert an empty one.

    A state is the last role and whether its turn came from the input, as only such a turn takes another in. Of equal
    costs the first offered wins: keep or relabel, then merge, then insertion, roles in the order of ROLES, states too.
    No turns: no steps, cost 0. A turn of unknown role costs a relabel wherever it goes.
    """
    if not roles:
        return 0, []
    now: dict[tuple[str | None, bool], tuple[int, list]] = {(None, False): (0, [])}
    for i, have in enumerate([*roles, FINAL]):
        # insertions before turn i; two of them at most lead anywhere new
        grown = dict(now)
        front = now
        for _ in range(2):
            new: dict = {}
            for (last, _real), (cost, steps) in front.items():
                for want in ROLES:
                    if (last, want) in LEGAL:
                        _offer(grown, new, (want, False), cost + INSERT, [steps, ("insert", want, None)])
            front = new
        if i == len(roles):
            cost, steps = min((v for (last, _), v in grown.items() if last == FINAL), key=lambda v: v[0])
            return cost, _unroll(steps)
        nxt: dict = {}
        for (last, _real), (cost, steps) in grown.items():
            for want in ROLES:
                if (last, want) in LEGAL:
                    _offer(nxt, nxt, (want, True), cost + (0 if have == want else RELABEL), [steps, ("keep" if have == want else "relabel", want, i)])
        for (last, real), (cost, steps) in now.items():
            if real:
                _offer(nxt, nxt, (last, True), cost + MERGE + (0 if have == last else RELABEL), [steps, ("merge", last, i)])
        now = nxt
    raise AssertionError


def _offer(all_states: dict, new: dict, state: tuple, cost: int, steps: list) -> None:
    if state not in all_states or cost < all_states[state][0]:
        all_states[state] = new[state] = (cost, steps)


def _unroll(steps: list) -> list[Step]:
    out = []
    while steps:
        steps, last = steps
        out.append(last)
    return out[::-1]


def render(turns: Sequence[tuple[str, str]]) -> str:
    """``<|role|>``, the text and ``<|end|>`` for each turn; ``<|`` in a text gets a blank between its signs."""
    return "".join(f"<|{name}|>\n{text.replace('<|', '< |')}<|end|>\n" for name, text in turns)


def apply(texts: Sequence[str | None], steps: Sequence[Step]) -> list[tuple[str, str]]:
    """The repaired turns; a merged text follows after a line break."""
    out: list[tuple[str, str]] = []
    for action, name, i in steps:
        text = "" if i is None else texts[i] or ""
        if action == "merge":
            out[-1] = (name, f"{out[-1][1]}\n{text}")
        else:
            out.append((name, text))
    return out


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cost, done, text = [], [], []
        for turns in batch.column("turns").to_pylist():
            c, steps = repair([role(t["role"]) for t in turns])
            cost.append(c)
            done.append(",".join(f"{action}:{name}" for action, name, _ in steps))
            text.append(render(apply([t["text"] for t in turns], steps)))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(cost, pa.int32()), pa.array(done), pa.array(text, pa.string())], ["conv_id", "cost", "steps", "rendered"])


def chat_format(turns: DataFrame) -> DataFrame:
    """(conv_id, cost, steps, rendered), one row for each conversation of ``turns`` (conv_id, turn, role, text).

    Turns go by number, null numbers first; those of equal number by role, then text, nulls first, so repeated rows
    stay next to each other and each counts. A null role or one of another name is unknown; a null text is empty. Which
    conversation a row of null conv_id belongs to isn't known, so each is one by itself. An empty table gives an empty
    table; further columns are ignored.
    """
    common.small_batches(turns.sparkSession)
    d = common.pick(turns, "conv_id", "turn", "role", "text")
    turn = F.struct("turn", "role", "text")
    grouped = d.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.union(d.where("conv_id IS NULL").select("conv_id", F.array(turn)))
    schema = T.StructType([d.schema["conv_id"], T.StructField("cost", T.IntegerType()), T.StructField("steps", T.StringType()), T.StructField("rendered", T.StringType())])
    return grouped.mapInArrow(_format, schema)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(common.documents(spark, sf_dir, "conversations"))


QUERIES = {"op7_chat": op7_chat}
