"""Conversations from reply trees, marked for training.

Messages know the message that they answer. Every message gets its depth, its root and the sum of the scores
on its way there by pointer doubling: in a round, each message that hasn't met its root joins the message
its pointer has come to and takes over that one's pointer, so a tree of depth d takes log2(d) rounds
of self-joins on message ids. Leaves are ranked by the mean score of their branch, the best few of each tree are
chosen, and their paths are enumerated by the same pointers: a path's messages known so far join the pointers that
lead 1, 2, 4, ... messages up. Only the paths that were chosen are ever enumerated, and texts join them last.

A path becomes one conversation: pieces of ``PIECE`` messages are put together first, then the pieces, so that what
meets for a path is a row for each piece. Marks: ``<|im_start|>role``, a line end, the text, ``<|im_end|>``, a line end. In roles
and texts, ``<`` and any back-slashes up to a ``|`` get one more back-slash: no mark is left in them and the change can be
taken back. Line ends of roles become a mark of their own. ``loss`` says for each message which characters behind its start
mark count for the loss: those of an assistant's text.

Cases: a null text or role is empty, a null score 0. A message whose parent is null, absent or itself begins a tree. Of repeated ids the
greatest by score, parent, role and text counts. A message without an id can't be answered: it is a tree of its own, and several such are one row each. An empty
table gives no rows; further columns of any names are ignored. Messages that answer each other in a ring have no root: an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataseek.llm.scratch import fence, materialize

# The marks of the template.
START, END, LINE_END = "<|im_start|>", "<|im_end|>", "<|nl|>"
LEARNT = "assistant"
#: Messages that are put together before pieces of a path meet.
PIECE = 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE_END))


def _plain_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE_END), F.lit("\n")))


# ---------------------------------------------------------------- turns as messages


def turns_as_replies(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """message_id, parent_id, conv_id, role, text, score (0): each row answers the row before it in its conversation, by turn, role and the MD5 of the text.

    Rows are sorted over all partitions and numbered by the counts of the partitions before theirs; a row's parent is the one with the
    number before, if it is of the same conversation. No task holds a whole conversation.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = ("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")))
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "turns")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("part", (before - F.shiftleft("part", 33)).alias("shift"))  # a row for each partition
    numbered = placed.withColumn("part", part).join(F.broadcast(shifts), "part")
    numbered = numbered.select((F.col("at") + F.col("shift")).alias("message_id"), "conv_id", "role", "text")
    ahead = numbered.select((F.col("message_id") + 1).alias("message_id"), F.col("message_id").alias("__at"), F.col("conv_id").alias("__conv"))
    own = numbered.join(ahead, "message_id", "left")
    parent = F.when(F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("__at").isNotNull(), F.col("__at"))
    return materialize(own.select("message_id", parent.alias("parent_id"), "conv_id", "role", "text", F.lit(0.0).alias("score")), "messages")


# ---------------------------------------------------------------- trees


def as_edges(messages: DataFrame, id_col: str, parent_col: str, score_col: str) -> DataFrame:
    """id, parent, score: parents that aren't there are null, and so is a message's own id."""
    own = messages.select(F.col(id_col).alias("id"), F.nullif(parent_col, id_col).alias("parent"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score"))
    known = own.select(F.col("id").alias("parent"), F.lit(True).alias("__there"))
    return own.join(known, "parent", "left").select("id", F.when(F.col("__there"), F.col("parent")).alias("parent"), "score")


def climb(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(id, root, depth, total) of all messages, and for k = 0, 1, ... the pairs (id, up) with ``up`` 2**k messages above.

    edges: id, parent, score, ids unique. total: the scores from the root down to the message. A message leaves the rounds once its pointer has met its root.
    """
    is_root = F.col("parent").isNull()
    first = edges.select(
        "id", F.col("parent").alias("up"), F.when(is_root, 0).otherwise(1).cast("long").alias("steps"), F.col("score").alias("total"), F.when(is_root, F.col("id")).alias("root")
    )
    state, done, levels = materialize(first, "pointers"), [], []
    most = state.count().bit_length() + 1
    while True:
        done.append(state.where("up IS NULL"))
        moving = state.where("up IS NOT NULL")
        if moving.isEmpty():
            break
        if len(levels) > most:
            raise ValueError("messages answer each other in a ring")
        levels.append(moving.select("id", "up"))
        met = moving
        for part in done:
            met = met.unionByName(part)
        met = met.select(F.col("id").alias("up"), *(F.col(c).alias(f"{c}_2") for c in ("up", "steps", "total", "root")))
        add = lambda c: (F.col(c) + F.col(f"{c}_2")).alias(c)
        state = materialize(moving.join(met, "up").select("id", F.col("up_2").alias("up"), add("steps"), add("total"), F.col("root_2").alias("root")), "pointers")
    found = done[0]
    for part in done[1:]:
        found = found.unionByName(part)
    return found.select("id", "root", F.col("steps").alias("depth"), "total"), levels


def rank_branches(climbed: DataFrame, edges: DataFrame, paths: int | None) -> DataFrame:
    """leaf, root, depth, branch_score, rank: the ``paths`` best branches of each tree (None: all) by mean score, then length, then the leaf's id."""
    leaves = climbed.join(edges.where("parent IS NOT NULL").select(F.col("parent").alias("id")), "id", "left_anti")
    scored = leaves.select(F.col("id").alias("leaf"), "root", "depth", (F.col("total") / (F.col("depth") + 1)).alias("branch_score"))
    order = Window.partitionBy("root").orderBy(F.col("branch_score").desc(), F.col("depth").desc(), "leaf")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if paths is None else ranked.where(F.col("rank") <= paths)


def path_members(chosen: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """leaf, id, position (from 0 at the root) of all messages of the chosen paths. A round doubles the part of each path that is known."""
    known = chosen.select("leaf", F.col("leaf").alias("id"), F.col("depth").alias("position"))
    for k, level in enumerate(levels):
        more = known.join(level, "id").select("leaf", F.col("up").alias("id"), (F.col("position") - 2**k).alias("position"))
        known = known.unionByName(materialize(more, "paths"))
    return known


# ---------------------------------------------------------------- format


def format_replies(
    messages: DataFrame, *, id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str = "score", tree_col: str | None = None, paths: int | None = 1, checked: bool = False,
) -> DataFrame:
    """tree, root, leaf, rank, branch_score, n_turns, formatted, loss (by message: start, length): a conversation for each chosen path.

    tree: the root's ``tree_col``. checked: ids are known to be unique, set and in the type of parents, and all parents to be there.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    tree = F.col(tree_col) if tree_col else F.lit(None).cast("string")
    own = messages.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)).alias("score"), tree.alias("tree"), text(role_col).alias("role"), text(text_col).alias("text"))
    if not checked:
        # Rows without an id get a key of their own; the others theirs.
        lone = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
        own = materialize(own.select(F.struct(F.col("id"), lone.alias("lone")).alias("id"), F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").cast(own.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("lone"))).alias("parent"), "score", "tree", "role", "text"), "messages")
        own = own.groupBy("id").agg(F.max(F.struct("score", "parent", "role", "text", "tree")).alias("m")).select("id", "m.*")
        own = materialize(own, "messages")
        edges = materialize(as_edges(own, "id", "parent", "score"), "edges")
    else:
        edges = own.select("id", "parent", "score")
    climbed, levels = climb(edges)
    chosen = materialize(rank_branches(climbed, edges, paths), "branches")
    members = path_members(chosen, levels).join(own.drop("parent", "score"), "id")

    role, said = F.col("__role"), F.col("__text")
    marked = members.select("leaf", "position", F.when(F.col("position") == 0, F.col("tree")).alias("tree"), _role(F.col("role")).alias("__role"), escape(F.col("text")).alias("__text"), (F.col("role") == LEARNT).alias("__learnt"))
    turn = F.struct(
        F.col("position").alias("at"),
        F.concat(F.lit(START), role, F.lit("\n"), said, F.lit(END + "\n")).alias("text"),
        F.struct((F.length(role) + 1).alias("start"), F.when(F.col("__learnt"), F.length(said)).otherwise(0).alias("length")).alias("loss"),
    )
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    pieces = marked.groupBy("leaf", F.floor(F.col("position") / PIECE).alias("piece")).agg(F.array_sort(F.collect_list(turn)).alias("t"), F.max("tree").alias("tree"))
    piece = F.struct(F.col("piece").alias("at"), joined("t").alias("text"), F.transform("t", lambda x: x["loss"]).alias("loss"))
    whole = pieces.select("leaf", "tree", piece.alias("p")).groupBy("leaf").agg(F.array_sort(F.collect_list("p")).alias("p"), F.max("tree").alias("tree"))
    whole = fence(whole).select("leaf", "tree", joined("p").alias("formatted"), F.flatten(F.transform("p", lambda x: x["loss"])).alias("loss"))
    out = whole.join(chosen, "leaf")
    plain = (lambda c: F.col(c)) if checked else (lambda c: F.col(f"{c}.id"))
    return out.select("tree", plain("root").alias("root"), plain("leaf").alias("leaf"), "rank", "branch_score", (F.col("depth") + 1).alias("n_turns"), "formatted", "loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns (role, text), taken from the marked text, and learnt: all text under the loss mask, without escapes."""
    # What stands in front of the first mark is nothing.
    split_up = fence(formatted.withColumn("__t", F.filter(F.split("formatted", START.replace("|", "\\|"), -1), lambda t: t != "")))
    role = lambda t: F.substring_index(t, "\n", 1)
    body = lambda t: F.substring(t, F.length(role(t)) + 2, F.length(t) - F.length(role(t)) - 2 - len(END))
    turns = F.transform("__t", lambda t: F.struct(_plain_role(role(t)).alias("role"), unescape(body(t)).alias("text")))
    learnt = F.array_join(F.zip_with("__t", "loss", lambda t, m: unescape(F.substring(t, m["start"] + 1, m["length"]))), "")
    return split_up.select(*formatted.columns, turns.alias("turns"), learnt.alias("learnt"))
