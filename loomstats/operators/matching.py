"""Match threads to the saved chat that began closest in time, with a bonus for the same prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import settings
from ..functions import text
from .ordered import Sequence

C = F.col
MINUTE_MS = 60_000

# Largest distance (wider after a title request) and score bonuses.
GAP_MS = 30 * MINUTE_MS
TITLE_GAP_MS = 120 * MINUTE_MS
EQUAL_BONUS_MS = 10 * MINUTE_MS
PART_BONUS_MS = 5 * MINUTE_MS

GRAM = 8
# Most heads and chats of one stretch of a session that a task holds, and chats found together by position.
FOLD_ROWS = 500_000
REACH_BLOCK = 256
ANY = ""
BEFORE, AFTER = "before", "after"
PLACE = ["list_no", "bucket", "probe", "side"]
THREAD = ["session_id", "thread_no", "started_ms", "saw_title_request", "prompt"]


def _prompt(value: Column) -> Column:
    return F.lower(text.collapse(F.coalesce(value, F.lit(""))))


def _bucket(ms: Column) -> Column:
    return F.floor(ms / TITLE_GAP_MS)


def _grams(prompt: Column) -> Column:
    """All substrings of up to GRAM characters."""
    return F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), F.length(prompt)),
        lambda start: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(prompt) - start + 1)),
            lambda size: F.substring(prompt, start, size),
        ),
    )))


def _contained(longer: DataFrame, shorter: DataFrame) -> DataFrame:
    """Pairs of prompts in the same time bucket where the first contains the second, found by the head of the second."""
    inner = longer.select("bucket", C("prompt").alias("outer"), F.explode(_grams(C("prompt"))).alias("gram"))
    heads = shorter.select("bucket", C("prompt").alias("inner"), F.substring("prompt", 1, GRAM).alias("gram"))
    return inner.join(heads, ["bucket", "gram"]).where(
        (C("outer") != C("inner")) & C("outer").contains(C("inner"))
    ).select("bucket", "outer", "inner")


def _probes(threads: DataFrame, chats: DataFrame, list_count: int) -> tuple[DataFrame, DataFrame]:
    """Groups in which each thread looks for its nearest chat, and the chats listed in each group.

    The groups are all chats, those with the thread's prompt and those whose prompt contains or is contained in it. Time
    buckets of the largest distance keep them apart: chats are listed in their own and both neighbouring buckets.
    """
    near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda shift: _bucket(C("created_ms")) + shift)
    chats = chats.where(C("created_ms").isNotNull() & C("chat_id").isNotNull()).select(
        "list_no", "chat_id", "created_ms", _prompt(C("first_text")).alias("prompt"), F.explode(near).alias("bucket")
    ).join(threads.select("bucket").distinct(), "bucket", "left_semi")
    thread_prompts = threads.where(C("prompt") != "").select("bucket", "prompt").distinct()
    chat_prompts = chats.where(C("prompt") != "").select("bucket", "prompt").distinct()
    pairs = _contained(thread_prompts, chat_prompts).select("bucket", C("outer").alias("prompt"), C("inner").alias("probe"))
    pairs = pairs.unionByName(
        _contained(chat_prompts, thread_prompts).select("bucket", C("inner").alias("prompt"), C("outer").alias("probe"))
    )
    own = F.explode(F.array_distinct(F.array(F.lit(ANY), C("prompt")))).alias("probe")
    probes = threads.select("*", own).unionByName(threads.join(pairs, ["bucket", "prompt"]))
    each_list = F.explode(F.array(*[F.lit(number) for number in range(list_count)])).alias("list_no")
    probes, listed = probes.select("*", each_list), chats.select("list_no", "bucket", own, "created_ms", "chat_id", "prompt")
    # Of the groups of prompts, only those with a chat; the group of all chats also tells where threads are.
    named = probes.where(C("probe") != ANY).join(
        listed.select("list_no", "bucket", "probe").distinct(), ["list_no", "bucket", "probe"], "left_semi"
    )
    return probes.where(C("probe") == ANY).unionByName(named), listed


def _heads(probes: DataFrame, listed: DataFrame, block_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Chats numbered by time in each group, and per thread, group and side the number of the nearest one.

    Among chats of the same time the smaller id is nearer, so there is one numbering per side.
    """
    group = ["list_no", "bucket", "probe"]
    offers = listed.select(*group, C("created_ms").alias("ms"), F.struct("created_ms", "chat_id", "prompt").alias("chat"))
    asks = probes.select(*group, C("started_ms").alias("ms"), F.struct(*THREAD).alias("thread"))
    both = offers.unionByName(asks, allowMissingColumns=True).withColumns({
        "is_thread": C("thread").isNotNull().cast("int"), "chat_id": C("chat.chat_id"), "backward": -C("chat.chat_id"),
    })
    both = settings.stored(both)
    is_chat = (C("is_thread") == 0).cast("long")
    numbered = lambda tie: Sequence(
        both, group, "ms", ["is_thread", tie], block_rows=block_rows
    ).running_sum({"pos": is_chat}).frame()
    after, before = numbered("chat_id"), numbered("backward")
    chats = None
    for side, rows in ((AFTER, after), (BEFORE, before)):
        part = rows.where(C("is_thread") == 0).select(*group, F.lit(side).alias("side"), "pos", "chat.*")
        chats = part if chats is None else chats.unionByName(part)
    # A thread comes after the chats of its own time: the last of them is `pos`, the next one `pos + 1`.
    sides = F.explode(F.array(
        F.struct(F.lit(BEFORE).alias("side"), C("pos").alias("pos")),
        F.struct(F.lit(AFTER).alias("side"), (C("pos") + 1).alias("pos")),
    )).alias("head")
    heads = after.where(C("is_thread") == 1).select(*group, "thread.*", sides).select(*group, *THREAD, "head.*")
    return heads, chats


def _score() -> Column:
    distance = F.abs(C("created_ms") - C("started_ms"))
    both = (C("prompt") != "") & (C("chat_prompt") != "")
    parts = C("prompt").contains(C("chat_prompt")) | C("chat_prompt").contains(C("prompt"))
    bonus = F.when(both & (C("prompt") == C("chat_prompt")), EQUAL_BONUS_MS).when(both & parts, PART_BONUS_MS).otherwise(0)
    return distance - bonus


def _at_heads(heads: DataFrame, chats: DataFrame) -> DataFrame:
    """The chats the heads point to, within the allowed distance."""
    found = heads.join(
        chats.withColumnRenamed("prompt", "chat_prompt"), [*PLACE, "pos"]
    )
    gap = F.when(C("saw_title_request"), TITLE_GAP_MS).otherwise(GAP_MS)
    return found.where(F.abs(C("created_ms") - C("started_ms")) <= gap).withColumn("score", _score())


def _best(found: DataFrame, thread: tuple[str, ...] = ("session_id", "thread_no")) -> DataFrame:
    best = F.min(F.struct("list_no", "score", "created_ms", "chat_id")).alias("best")
    return found.groupBy(*thread).agg(best).select(*thread, "best.*")


def _prepared(threads: DataFrame, *lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    threads = threads.withColumns({"prompt": _prompt(C("first_prompt")), "bucket": _bucket(C("started_ms"))})
    chats = None
    for number, chat_list in enumerate(lists):
        part = chat_list.select(F.lit(number).alias("list_no"), "chat_id", "created_ms", "first_text")
        chats = part if chats is None else chats.unionByName(part)
    return _probes(threads.select(*THREAD, "bucket"), chats, len(lists))


def nearest_chats(threads: DataFrame, chats: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Best chat of each thread, or none within the allowed distance; several threads may get the same chat.

    `threads`: session_id, thread_no, started_ms, saw_title_request, first_prompt; `chats`: chat_id (a number),
    created_ms, first_text. The score of a chat is its distance in time less the bonus of its prompt; ties go to the chat
    created first, then to the smaller id. (A chat within that distance is also within the six hours around the session
    that limit the candidates, since a thread starts inside its session.)

    The best chat is the nearest one before or after the thread in one of the groups of `_probes`, so each thread looks up
    two chats per group instead of being compared with every chat in reach.
    """
    threads = settings.stored(threads.select(*THREAD[:-1], "first_prompt"))
    heads, numbered = _heads(*_prepared(threads, chats), block_rows)
    return _best(_at_heads(heads, numbered)).select("session_id", "thread_no", "chat_id", "score")


def _stretches(heads: DataFrame) -> DataFrame:
    """Per session and occupied time bucket: its stretch of buckets, and the threads of that stretch.

    Threads that can want the same chat are at most two buckets apart, so those of different stretches never compete.
    """
    first = (C("list_no") == 0) & (C("probe") == ANY) & (C("side") == BEFORE)
    buckets = heads.groupBy("session_id", "bucket").agg(F.count_if(first).alias("n_here"))
    in_time = Window.partitionBy("session_id").orderBy("bucket")
    opens = F.coalesce(C("bucket") - F.lag("bucket").over(in_time) > 2, F.lit(True)).cast("int")
    return buckets.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(in_time)).select(
        "session_id", "bucket", "stretch", F.sum("n_here").over(Window.partitionBy("session_id", "stretch")).alias("n_threads")
    )


def _reach(heads: DataFrame, chats: DataFrame) -> DataFrame:
    """Intervals of chats that a stretch can need, by group and side.

    Counted outward, a thread needs at most as many chats from its head on as its stretch has threads: the others have
    taken one each. An interval ends where the next head of the same group begins, so intervals never overlap.
    """
    ends = chats.groupBy(*PLACE).agg(F.max("pos").alias("n_listed"))
    starts = heads.select("session_id", "stretch", "n_threads", *PLACE, _outward().alias("start")).distinct()
    following = F.lead("start").over(Window.partitionBy("session_id", "stretch", *PLACE).orderBy("start"))
    stop = F.least(
        C("start") + C("n_threads") - 1, F.coalesce(C("following") - 1, C("start") + C("n_threads") - 1),
        F.when(C("side") == AFTER, C("n_listed")).otherwise(F.lit(-1)),
    )
    return starts.withColumn("following", following).join(ends, PLACE).withColumn("stop", stop).where(
        C("start") <= C("stop")
    ).select("session_id", "stretch", *PLACE, "start", "stop")


def _outward() -> Column:
    """Position of a head or chat, growing with the distance on both sides."""
    return F.when(C("side") == AFTER, C("pos")).otherwise(-C("pos"))


def _block(position: Column) -> Column:
    return F.floor(position / REACH_BLOCK)


def _offers(reach: DataFrame, chats: DataFrame) -> DataFrame:
    """The chats in the intervals, found by blocks of positions."""
    wanted = reach.withColumn("block", F.explode(F.sequence(_block(C("start")), _block(C("stop")))))
    placed = chats.select(*PLACE, _outward().alias("out"), _block(_outward()).alias("block"), "created_ms", "chat_id")
    return wanted.join(placed, [*PLACE, "block"]).where(C("out").between(C("start"), C("stop"))).select(
        "session_id", "stretch", "list_no", _place(), "out", "created_ms", "chat_id"
    )


def _place() -> Column:
    """Bucket, group and side in short form: prompts can be long."""
    return F.md5(F.concat_ws(":", "bucket", "side", "probe")).alias("place")


def _walk(batches):
    """Threads of each stretch in order, each taking the best chat left. Rows come by session and stretch, chats first.

    Of each group a thread looks at the first free chat outward. `ahead` leads from a taken chat past the taken ones behind
    it and is shortened on every walk, so the walks of all threads together take little more than one step each.
    """
    import pyarrow as pa

    stretch, thread, best, kept = None, None, None, []
    listed, ahead, taken = {}, {}, set()

    def take():
        if best is not None:
            taken.add(best[3])
            kept.append((stretch[0], thread, best[0], best[3], best[1]))

    names = ("session_id", "stretch", "thread_no", "started_ms", "gap", "bonus", "list_no", "place", "out", "created_ms", "chat_id")
    schema = None
    for batch in batches:
        if schema is None:
            fields = [batch.schema.field(name) for name in ("session_id", "thread_no", "list_no", "chat_id")]
            schema = pa.schema([*fields, pa.field("score", pa.int64())])
        for session, part, number, started, gap, bonus, list_no, place, out, created, chat in zip(
            *(batch[name].to_pylist() for name in names)
        ):
            if (session, part) != stretch:
                take()
                stretch, thread, best = (session, part), None, None
                listed, ahead, taken = {}, {}, set()
            spot = (list_no, place, out)
            if started is None:
                listed[spot] = (created, chat)
                continue
            if number != thread:
                take()
                thread, best = number, None
            while spot in listed and listed[spot][1] in taken:
                following = ahead.get(spot, (list_no, place, spot[2] + 1))
                ahead[spot] = ahead.get(following, following)
                spot = ahead[spot]
            if spot in listed:
                created, chat = listed[spot]
                distance = abs(created - started)
                offer = (list_no, distance - bonus, created, chat)
                if distance <= gap and (best is None or offer < best):
                    best = offer
        if kept:
            yield _rows(kept, schema)
            kept.clear()
    take()
    if kept:
        yield _rows(kept, schema)


def _rows(rows, schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _walked(heads: DataFrame, reach: DataFrame, chats: DataFrame) -> DataFrame:
    """Assignment of whole stretches, each by one walk over its threads; a task walks many of them."""
    gap = F.when(C("saw_title_request"), TITLE_GAP_MS).otherwise(GAP_MS).cast("long")
    # All chats of a group have one prompt, or any: those of an equal or partly equal prompt are in a group of their own.
    bonus = F.when(C("probe") == ANY, 0).when(C("probe") == C("prompt"), EQUAL_BONUS_MS).otherwise(PART_BONUS_MS)
    asks = heads.select(
        "session_id", "stretch", "thread_no", "started_ms", gap.alias("gap"), bonus.cast("long").alias("bonus"),
        "list_no", _place(), _outward().alias("out"),
    )
    schema = T.StructType([
        heads.schema["session_id"], heads.schema["thread_no"], heads.schema["list_no"],
        T.StructField("chat_id", chats.schema["chat_id"].dataType), T.StructField("score", T.LongType()),
    ])
    by = ["session_id", "stretch"]
    rows = asks.unionByName(_offers(reach, chats), allowMissingColumns=True).repartition(*by)
    in_order = [*by, C("started_ms").isNotNull(), C("thread_no").asc_nulls_last()]
    return rows.sortWithinPartitions(*in_order).mapInArrow(_walk, schema)


def assign_chats(
    threads: DataFrame, *lists: DataFrame, block_rows: int | None = None, fold_rows: int = FOLD_ROWS
) -> DataFrame:
    """Give each thread its best chat that no earlier thread of the session took; a later list is used where none fits.

    A chat id stands once in a list. Threads of a session compete only within a stretch of time (`_stretches`). Where no two
    threads of a stretch have the same best chat, each gets it: no earlier thread took it. The threads of any other stretch
    are walked once in order (`_walk`), with the chats they can need (`_reach`). So the number of jobs does not depend on the conflicts. A stretch of more than
    `fold_rows` heads and chats, which one task should not hold, is settled by `_in_rounds` instead, with the same result.
    """
    heads, numbered = _heads(*_prepared(threads, *lists), block_rows)
    heads, numbered = settings.stored(heads.where(C("bucket").isNotNull())), settings.stored(numbered)
    by = ["session_id", "stretch"]
    placed = heads.join(_stretches(heads), ["session_id", "bucket"])
    wishes = settings.stored(_best(_at_heads(placed, numbered), ("session_id", "stretch", "thread_no")))
    rivals = wishes.groupBy(*by, "chat_id").agg(F.count(F.lit(1)).alias("n")).where(C("n") > 1).select(*by).distinct()
    rivals = settings.cut_lineage(rivals)
    shared = placed.join(rivals, by, "left_semi")
    reach = settings.stored(_reach(shared, numbered))
    held = shared.select(*by, F.lit(1).alias("rows")).unionByName(
        reach.select(*by, (C("stop") - C("start") + 1).alias("rows"))
    ).groupBy(*by).agg(F.sum("rows").alias("rows"))
    large = settings.cut_lineage(held.where(C("rows") > fold_rows).select(*by))
    columns = ["session_id", "thread_no", "list_no", "chat_id", "score"]
    done = wishes.join(rivals, by, "left_anti").select(*columns)
    small = [part.join(large, by, "left_anti") for part in (shared, reach)]
    done = done.unionByName(_walked(*small, numbered))
    if large.isEmpty():
        return done
    return done.unionByName(_in_rounds(shared.join(large, by, "left_semi").select(heads.columns), numbered))


def _in_rounds(heads: DataFrame, numbered: DataFrame) -> DataFrame:
    """The same assignment without gathering a stretch.

    Every thread holds its best chat. Where several threads of a session hold the same one, the earliest keeps it and the
    others move on to their next best: in each group that points to the lost chat, to the following one outward. When no
    chat is held twice, each thread has the best chat the earlier ones left. Only sessions with a conflict take part in
    the next round.
    """
    heads = settings.cut_lineage(heads)
    done = None
    while True:
        found = settings.cut_lineage(_at_heads(heads, numbered))
        held = settings.cut_lineage(_best(found))
        first = held.groupBy("session_id", "chat_id").agg(F.min("thread_no").alias("keeper"))
        lost = held.join(first, ["session_id", "chat_id"]).where(C("thread_no") != C("keeper")).select(
            "session_id", "thread_no", "chat_id"
        )
        lost = settings.cut_lineage(lost)
        open_sessions = lost.select("session_id").distinct()
        settled = held.join(open_sessions, "session_id", "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if lost.isEmpty():
            return done.select("session_id", "thread_no", "list_no", "chat_id", "score")
        place = ["session_id", "thread_no", "list_no", "bucket", "probe", "side"]
        moved = found.join(lost, ["session_id", "thread_no", "chat_id"], "left_semi").select(
            *place, F.when(C("side") == BEFORE, -1).otherwise(1).alias("step")
        )
        heads = settings.cut_lineage(
            heads.join(open_sessions, "session_id", "left_semi").join(moved, place, "left")
            .withColumn("pos", C("pos") + F.coalesce("step", F.lit(0))).drop("step")
        )


def match_titles(threads: DataFrame, titles: DataFrame, sessions: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Threads with their matched chat and title: from the title records, else from the full chat sessions."""
    threads = settings.stored(threads)
    matched = assign_chats(threads, titles, sessions, block_rows=block_rows)
    names = titles.select("chat_id", "title", F.lit(0).alias("list_no")).unionByName(
        sessions.select("chat_id", "title", F.lit(1).alias("list_no"))
    )
    named = matched.join(names, ["chat_id", "list_no"]).select(
        "session_id", "thread_no", "chat_id", C("title").alias("matched_title")
    )
    return threads.join(named, ["session_id", "thread_no"], "left")
