"""Chat formatting: a hidden Markov model recovers who speaks, then turns are rendered in one form.

A transcript is a sequence of turns. A turn without a known role is cut before lines that begin with
the name of a speaker, and one with a role only if it is a transcript itself: it begins with a name of
its own role, and such lines recur. What is seen of a piece is its marker (the given role, or the name
in the line, if any) and features of its text: length, a question at its end, code, a list. The hidden
states are the roles. A given role is certain; a name in a line is evidence, more of it for names that
are nothing else than names. How features follow from roles, and roles from each other, is counted
over all marked pieces. Viterbi decoding fills in what is left open.

Conversations are decoded in blocks of a bounded number of pieces, many blocks at once. Where one has
several blocks, the best scores from every state before a block to every state at its end form a small
matrix; matrices are combined in a tree, and the known end states are handed down again. That is
exact, and a conversation that holds a third of all turns is many tasks. Texts are not moved to decode
them, only codes of what is seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bazaarlens.operators.ranking import dense_index
from bazaarlens.workspace import materialize

ROLES = ("system", "user", "assistant", "tool")
#: Names of speakers, by role.
SPEAKERS: Mapping[str, tuple[str, ...]] = {
    "system": ("system", "instruction", "instructions"),
    "user": ("user", "human", "customer", "question", "prompter", "q"),
    "assistant": ("assistant", "bot", "ai", "gpt", "model", "answer", "agent", "a"),
    "tool": ("tool", "function", "observation"),
}
#: Names that are words of any text, too, such as the letters of a list.
WEAK_NAMES = frozenset("a q ai agent answer customer function instruction instructions model observation question tool".split())
#: How likely a conversation begins with a role, and a role is followed by another, before anything is counted,
#: and as how many counts that weighs: fixed parameters.
START = (0.3, 0.65, 0.04, 0.01)
FOLLOWS = ((0.02, 0.9, 0.07, 0.01), (0.01, 0.06, 0.9, 0.03), (0.01, 0.9, 0.05, 0.04), (0.01, 0.05, 0.93, 0.01))
PRIOR = 20.0
#: How likely a marker names the role of its piece: given roles, names, weak names.
TRUST = (1.0 - 1e-9, 0.98, 0.8)
GIVEN, NAMED, WEAK = range(3)
_LENGTHS, _FEATURES = 12, 12 * 8
#: Blocks, and matrices of a level of the tree, that are combined at once; blocks decoded at once.
_BLOCK, _AT_ONCE = 256, 512


def _speaker(names: Iterator[str]) -> str:
    """A pattern of the start of a line that names a speaker."""
    return rf"^[ \t]*(?:#+[ \t]*|<\|?|\*\*|\[)?({'|'.join(names)})(?:\|?>|\*\*|\])?[ \t]*:[ \t]*"


_SPEAKER = _speaker(n for names in SPEAKERS.values() for n in names)
_STRONG_SPEAKER = _speaker(n for names in SPEAKERS.values() for n in names if n not in WEAK_NAMES)


def role_of(name: Column) -> Column:
    """The number of the role a name stands for; null for no or an unknown name."""
    lowered = F.lower(F.trim(name))
    found = F.lit(None).cast("int")
    for number, role in enumerate(ROLES):
        found = F.when(lowered.isin(*SPEAKERS[role]), number).otherwise(found)
    return found


def _named_roles(text: Column, pattern: str) -> tuple[Column, Column]:
    """The lower-case names that begin lines of a text, and their distinct roles."""
    names = F.transform(F.regexp_extract_all(text, F.lit(f"(?im){pattern}"), F.lit(1)), F.lower)
    return names, F.array_distinct(F.transform(names, role_of))


def pieces(df: DataFrame) -> DataFrame:
    """``spoken, marker, kind, piece`` and ``part`` of turns ``given, text``, which are cut where speakers change.

    ``spoken`` is the role that the name at the start of a piece stands for, ``marker`` the role it is
    marked with and ``kind`` how: a given role stands for the first piece, whatever its line says.
    """
    given = role_of(F.col("given"))
    names, roles = _named_roles(F.col("text"), _SPEAKER)
    _, strong_roles = _named_roles(F.col("text"), _STRONG_SPEAKER)
    opening = role_of(F.regexp_extract("text", f"(?i){_SPEAKER}", 1))
    strong_opening = role_of(F.regexp_extract("text", f"(?i){_STRONG_SPEAKER}", 1))
    recurs = (F.size(names) >= 3) & (F.size(F.array_distinct(names)) < F.size(names)) & (F.size(roles) >= 2)
    everywhere = recurs & (given.isNull() | F.coalesce(opening == given, F.lit(False)))
    at_names = given.isNull() | (F.coalesce(strong_opening == given, F.lit(False)) & (F.size(strong_roles) >= 2))
    parts = (
        F.when(everywhere, F.split("text", rf"(?im)(?={_SPEAKER})"))
        .when(at_names, F.split("text", rf"(?im)(?={_STRONG_SPEAKER})"))
        .otherwise(F.array("text"))
    )
    cut = df.select("*", F.posexplode(parts).alias("part", "piece"))
    name = F.lower(F.regexp_extract("piece", f"(?i){_SPEAKER}", 1))
    first = (F.col("part") == 0) & given.isNotNull()
    spoken = role_of(name)
    return cut.select(
        *[c for c in df.columns if c != "text"], "part", "piece",
        spoken.alias("spoken"),
        F.when(first, given).otherwise(spoken).alias("marker"),
        F.when(first, GIVEN).when(name.isin(*sorted(WEAK_NAMES)), WEAK).otherwise(NAMED).alias("kind"),
    )


def body(role: Column) -> Column:
    """The text of a piece of that role: its name goes where it says the same."""
    unnamed = F.regexp_replace("piece", f"(?i){_SPEAKER}", "")
    return F.trim(F.when(F.col("spoken") == role, unnamed).otherwise(F.col("piece")), F.lit(" \t\r\n"))


def feature(body: Column) -> Column:
    """A number for what a piece looks like: length on a log scale, question, code, list."""
    long = F.least(F.floor(F.log2(F.length(body) + 1)), F.lit(_LENGTHS - 1)).cast("int")
    marks = [body.rlike(r"[?？]\s*$"), body.contains("```") | body.rlike(r"(?m)^ {4}\S"), body.rlike(r"(?m)^\s*(?:[-*]|\d+[.)]) ")]
    return long * 8 + sum((m.cast("int") * 2**i for i, m in enumerate(marks)), F.lit(0))


def in_conversations(seen: DataFrame) -> DataFrame:
    """``first`` and ``slot`` beside rows ``conv_id, position``: the first position of a conversation, and the place in it.

    ``position`` numbers all rows of all conversations, one conversation after the other. ``first``
    then stands for the conversation, a missing one, too.
    """
    first = seen.groupBy("conv_id").agg(F.min("position").alias("first")).withColumnRenamed("conv_id", "__conv")
    joined = seen.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")))
    return joined.drop("__conv", "conv_id").withColumn("slot", F.col("position") - F.col("first"))


def learned_emissions(seen: DataFrame) -> np.ndarray:
    """Log likelihood of every feature given the role, from counts over all marked pieces, smoothed."""
    counts = np.ones((len(ROLES), _FEATURES))
    marked = seen.filter(F.col("marker").isNotNull() & (F.col("kind") != WEAK))
    # One row per role and feature.
    for row in marked.groupBy("marker", "feature").agg(F.count("*").alias("n")).collect():
        counts[row["marker"], row["feature"]] += row["n"]
    return np.log(counts / counts.sum(axis=1, keepdims=True))


def learned_transitions(seen: DataFrame, block: int = _BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """How likely a conversation begins with a role, and a role is followed by another, counted over marked pieces.

    The last row of a block is the leading one of the next, so every two neighbours meet once.
    """
    blocks = F.array_distinct(F.array(F.floor(F.col("slot") / block), F.floor((F.col("slot") + 1) / block)))
    sure = F.when(F.col("kind") != WEAK, F.col("marker"))
    spread = seen.select("first", "slot", sure.alias("marker"), F.explode(blocks).alias("block"))
    before = F.lag("marker").over(Window.partitionBy("first", "block").orderBy("slot"))
    starts = (F.col("slot") == 0) & (F.col("block") == 0)
    # At most one row per two roles, and one per role.
    counted = (
        spread.select("marker", before.alias("before"), starts.alias("starts"))
        .filter(F.col("marker").isNotNull() & (F.col("before").isNotNull() | F.col("starts")))
        .groupBy("before", "marker").agg(F.count("*").alias("n")).collect()
    )
    start, follows = PRIOR * np.array(START), PRIOR * np.array(FOLLOWS)
    for row in counted:
        if row["before"] is None:
            start[row["marker"]] += row["n"]
        else:
            follows[row["before"], row["marker"]] += row["n"]
    return start / start.sum(), follows / follows.sum(axis=1, keepdims=True)


def code_scores(emissions: np.ndarray) -> np.ndarray:
    """Log likelihood of what is seen for every code and role.

    A code is ``(marking) * features + feature``; marking 0 is no marker, then come roles by kind.
    """
    states = len(ROLES)
    markings = np.zeros((1 + states * len(TRUST), states))
    for kind, trust in enumerate(TRUST):
        other = math.log((1.0 - trust) / (states - 1))
        markings[1 + states * kind : 1 + states * (kind + 1)] = np.where(np.eye(states) > 0, math.log(trust), other)
    return (markings[:, None, :] + emissions.T[None, :, :]).reshape(-1, states)


def _padded(codes: list[np.ndarray], scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length, the lengths in that order, and the scores of all rows, padded."""
    lengths = np.array([len(c) for c in codes])
    order = np.argsort(-lengths, kind="stable")
    padded = np.zeros((len(codes), int(lengths.max())), dtype=np.int64)
    for i, k in enumerate(order):
        padded[i, : lengths[k]] = codes[k]
    return order, lengths[order], scores[padded]


def block_matrices(codes: list[np.ndarray], opens: np.ndarray, scores: np.ndarray, start: np.ndarray, step: np.ndarray) -> np.ndarray:
    """For many blocks, the best log score from every state before to every state at the end.

    Where a block ``opens`` its conversation, there is no state before and all rows are the same.
    """
    order, lengths, rows = _padded(codes, scores)
    best = np.where(opens[order, None, None], start[None, None, :], step[None, :, :]) + rows[:, 0, None, :]
    for t in range(1, rows.shape[1]):
        n = int((lengths > t).sum())
        best[:n] = (best[:n, :, :, None] + step[None, None, :, :]).max(axis=2) + rows[:n, t, None, :]
    result = np.empty_like(best)
    result[order] = best
    return result


def best_paths(
    codes: list[np.ndarray], before: np.ndarray, last: np.ndarray, scores: np.ndarray, start: np.ndarray, step: np.ndarray
) -> list[np.ndarray]:
    """Viterbi over many blocks: the states of each, after state ``before`` (-1: none) to state ``last`` (-1: any).

    Ties go to the earlier role.
    """
    order, lengths, rows = _padded(codes, scores)
    opening = np.where(before[order, None] < 0, start[None, :], step[np.maximum(before[order], 0)])
    best = opening + rows[:, 0]
    back = np.zeros(rows.shape, dtype=np.int8)
    for t in range(1, rows.shape[1]):
        n = int((lengths > t).sum())
        options = best[:n, :, None] + step[None, :, :]
        back[:n, t] = options.argmax(axis=1)
        best[:n] = options.max(axis=1) + rows[:n, t]
    state = np.where(last[order] < 0, best.argmax(axis=1), last[order])
    paths = np.zeros(rows.shape[:2], dtype=np.int8)
    at = np.arange(len(codes))
    for t in range(rows.shape[1] - 1, -1, -1):
        n = int((lengths > t).sum())
        inside = lengths[:n] - 1 > t
        state[:n] = np.where(inside, back[at[:n], min(t + 1, rows.shape[1] - 1), state[:n]], state[:n])
        paths[:n, t] = state[:n]
    result: list[np.ndarray] = [np.empty(0)] * len(codes)
    for i, k in enumerate(order):
        result[k] = paths[i, : lengths[i]]
    return result


def recover_roles(
    seen: DataFrame,
    emissions: np.ndarray,
    block: int = _BLOCK,
    start: np.ndarray | None = None,
    follows: np.ndarray | None = None,
    fan: int = _BLOCK,
) -> DataFrame:
    """``position, first, state`` and all further columns of rows ``first, slot, position, marker, kind, feature``."""
    begin = np.log(np.array(START) if start is None else start)
    step = np.log(np.array(FOLLOWS) if follows is None else follows)
    scores = code_scores(emissions)
    states = len(ROLES)
    carried = [c for c in seen.columns if c not in ("first", "slot", "position", "marker", "kind", "feature")]
    marking = F.coalesce(1 + states * F.col("kind") + F.col("marker"), F.lit(0))
    held = F.struct("slot", (marking * _FEATURES + F.col("feature")).alias("code"), *carried)
    kinds = {c: seen.schema[c].dataType.simpleString() for c in carried}
    blocks = materialize(
        # A block is bounded, whatever the size of its conversation.
        seen.groupBy("first", F.floor(F.col("slot") / block).alias("block"))
        .agg(F.array_sort(F.collect_list(held)).alias("held"))
        .select("first", "block", *[F.col(f"held.{c}").alias(c) for c in ("code", *carried)]),
        "chat",
    )

    def in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), _AT_ONCE):
                yield batch.iloc[at : at + _AT_ONCE]

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_parts(batches):
            found = block_matrices(list(part["code"]), (part["block"] == 0).to_numpy(), scores, begin, step)
            yield pd.DataFrame({"first": part["first"], "block": part["block"], "matrix": list(found.reshape(len(part), -1))})

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_parts(batches):
            found = []
            for flat in part["matrices"]:
                product, *others = (np.array(m).reshape(states, states) for m in flat)
                for other in others:
                    product = (product[:, :, None] + other[None, :, :]).max(axis=1)
                found.append(product.ravel())
            yield pd.DataFrame({"first": part["first"], "block": part["block"], "matrix": found})

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The states before and at the end of each block of a group, between those of the group."""
        for part in in_parts(batches):
            for row in part.itertuples(index=False):
                best, back = None, []
                for flat in row.matrices:
                    matrix = np.array(flat).reshape(states, states)
                    if best is None:
                        best = matrix[max(row.before, 0)]
                        continue
                    options = best[:, None] + matrix
                    back.append(options.argmax(axis=0))
                    best = options.max(axis=0)
                last = [row.last if row.last >= 0 else int(best.argmax())]
                for choice in reversed(back):
                    last.append(int(choice[last[-1]]))
                last.reverse()
                yield pd.DataFrame(
                    {"first": row.first, "block": row.blocks, "before": [row.before, *last[:-1]], "last": last}
                )

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in in_parts(batches):
            paths = best_paths(list(part["code"]), part["before"].to_numpy(), part["last"].to_numpy(), scores, begin, step)
            yield part[["first", "block", *carried]].assign(state=paths)

    spark = seen.sparkSession
    known = spark.createDataFrame([], "first bigint, block bigint, before int, last int")
    top = blocks.agg(F.max("block")).first()[0] or 0
    if top:
        several = blocks.filter("block = 1").select("first")
        level = blocks.join(several, "first", "left_semi").select("first", "block", "code")
        level = level.mapInPandas(matrices, "first bigint, block bigint, matrix array<double>")
        groups = []
        while top:
            grouped = level.groupBy("first", F.floor(F.col("block") / fan).alias("group")).agg(
                F.array_sort(F.collect_list(F.struct("block", "matrix"))).alias("held")
            )
            grouped = grouped.select(
                "first", F.col("group").alias("block"), F.col("held.block").alias("blocks"), F.col("held.matrix").alias("matrices")
            )
            groups.append(materialize(grouped, "chat"))
            level = groups[-1].mapInPandas(products, "first bigint, block bigint, matrix array<double>")
            top //= fan
        known = groups[-1].select("first", "block", F.lit(-1).alias("before"), F.lit(-1).alias("last"))
        for stored in reversed(groups):
            between = stored.join(known, ["first", "block"]).select("first", "blocks", "matrices", "before", "last")
            known = materialize(between.mapInPandas(ends, known.schema), "chat")
    ready = blocks.join(known, ["first", "block"], "left").select(
        "first", "block", "code", *carried, F.coalesce("before", F.lit(-1)).alias("before"), F.coalesce("last", F.lit(-1)).alias("last")
    )
    lists = ", ".join(["first bigint, block bigint", *[f"{c} array<{k}>" for c, k in kinds.items()], "state array<tinyint>"])
    decoded = ready.mapInPandas(decode, lists).select("first", "block", F.posexplode(F.arrays_zip("state", *carried)))
    return decoded.select(
        (F.col("first") + F.col("block") * block + F.col("pos")).alias("position"), "first", "col.*"
    )


def format_chats(df: DataFrame, conv: str, turn: str, role: str, text: str, block: int = _BLOCK) -> DataFrame:
    """``conv_id, turn, part, slot, role, recovered, rendered`` for every piece of every turn.

    ``slot`` numbers the pieces of a conversation from 0 in order of turn, role and text; joined in
    that order, ``rendered`` is the conversation. ``recovered`` says that no marker named the role.
    A null conversation id is a conversation of its own, null turns come first, a null text is empty,
    an unknown role is no marker. Equal rows are turns of their own, one after the other. An empty
    table has no rows, and columns beside the four named ones are not read.
    """
    turns = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("given"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).withColumn("digest", F.sha2("text", 256))
    # The number of a row is stored, so it is the same wherever the pieces are read.
    numbered = turns.withColumn("row", F.monotonically_increasing_id())
    cut = materialize(pieces(numbered).withColumn("feature", feature(body(F.col("marker")))), "chat")
    order = ["conv_id", "turn", "given", "digest", "row", "part"]
    codes = dense_index(cut.select(*order, "marker", "kind", "feature"), [F.col(c) for c in order], "position")
    seen = materialize(in_conversations(codes.drop("turn", "given", "digest")), "chat")
    start, follows = learned_transitions(seen, block)
    states = recover_roles(seen, learned_emissions(seen), block, start, follows)
    placed = states.select("row", "part", (F.col("position") - F.col("first")).alias("slot"), F.col("state").cast("int").alias("state"))
    found = F.array(*[F.lit(r) for r in ROLES])[F.col("state")]
    return cut.join(placed, ["row", "part"]).select(
        "conv_id",
        "turn",
        "part",
        "slot",
        found.alias("role"),
        F.coalesce(F.col("marker") != F.col("state"), F.lit(True)).alias("recovered"),
        F.concat(F.lit("<|"), found, F.lit("|>\n"), body(F.col("state")), F.lit("<|end|>\n")).alias("rendered"),
    )
