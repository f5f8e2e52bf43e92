"""Sharding by balanced label propagation, with Spark joins and windows alone.

Documents with equal texts are linked. A document's label is its shard. Labels start as equal
stretches of the documents in the order of a hash that knows nothing of the groups, so that nearly
every group starts cut. In each round the members that a group has in one shard look at the shards of
the others, and propose to move to the one that holds most of them, full shards last. Proposals from
shard i to shard j are taken, least bytes first, while the quota of that way lasts: what goes the other
way, and a share of the room that j has left. Documents that are linked to none make room: they are
dealt last, into what the others leave, so that shards come out even. A group that is larger than a
shard fills shards one after another.

Members of a group are alike, so a round joins and moves counts (group, shard, members), which do not
grow with the size of a group, and the documents follow once the rounds are over. Running sums are
taken in two steps, inside cells and over the cells, so that no window holds more than a cell.

Law ``bytes``: shard sizes are near equal. A size is the UTF-8 bytes of a text (null: none) plus
one. Defined results: null and empty texts form one group; very long texts are placed whole; repeated
rows are documents of their own; a null doc_id keeps its row; of labels that hold equally many, the
one of the larger hash of group, shard and round wins, and of rows that are alike any may move; an empty
table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import staged

SHARDS = 8
#: How far above the mean size a shard may grow in label propagation.
SLACK = 0.002
ROUNDS = 10
CELL_BITS = 12
SALTS = 64
GROUP = ("h", "crc", "size")


def _running(df: DataFrame, scope: list[str], cell: Column, order: list[str | Column], value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the rows before each one, in order of cell and ``order``."""
    # dealt by cell, so that rows that came together for a join of the scope part again
    rows = df.withColumn("_cell", cell).withColumn("_value", value).repartition(*scope, "_cell")
    inside = Window.partitionBy(*scope, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    cells = df.withColumn("_cell", cell).groupBy(*scope, "_cell").agg(F.sum(value).alias("_sum"))
    # as many rows as there are cells, of which there is a fixed number in a scope
    over = Window.partitionBy(*scope).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_before", F.coalesce(F.sum("_sum").over(over), F.lit(0))).drop("_sum")
    return rows.join(cells, [*scope, "_cell"]).withColumn(out, F.col(out) + F.col("_before")).drop("_cell", "_value", "_before")


def _placed(docs: DataFrame) -> DataFrame:
    """One narrow row per document, with a row number that is fixed once written.

    ``u`` orders the documents without regard to their groups; ``salt`` splits rows that are alike.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("row")
    )
    return rows.withColumn("u", F.xxhash64("doc_id", "h", "crc")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))


def _stretched(rows: DataFrame, edges: DataFrame, out: str) -> DataFrame:
    """``out``: the stretch between ``edges`` (one row: an array of ascending ends) in which each row's middle byte lies."""
    units = rows.groupBy("u", "size", "salt").agg(F.sum("size").alias("bytes"))
    units = _running(units, [], F.shiftrightunsigned("u", 64 - CELL_BITS), ["u", "size", "salt"], F.col("bytes"), "unit_before")
    inside = Window.partitionBy("u", "size", "salt").orderBy("row")
    middle = F.col("unit_before") + (F.row_number().over(inside) - 1) * F.col("size") + F.col("size") / 2
    placed = rows.join(units.drop("bytes"), ["u", "size", "salt"]).withColumn("_middle", middle).crossJoin(F.broadcast(edges))  # one row
    stretch = F.least(F.size(F.filter("edges", lambda e: e <= F.col("_middle"))), F.size("edges") - 1)
    return placed.withColumn(out, stretch.cast("int")).drop("edges", "_middle", "unit_before")


def _even(rows: DataFrame, shards: int) -> DataFrame:
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("_total"))
    return total.select(F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: i * F.col("_total") / shards).alias("edges"))


def _tallies(rows: DataFrame) -> DataFrame:
    """(group, shard, n) of the groups of two members or more."""
    tally = rows.groupBy(*GROUP, "shard").agg(F.count("*").alias("n"))
    linked = tally.groupBy(*GROUP).agg(F.sum("n").alias("_members")).where("_members > 1").drop("_members")
    return tally.join(linked, list(GROUP))


def _loads(tally: DataFrame, shards: int) -> DataFrame:
    """The bytes of linked documents in every shard: as many rows as there are shards."""
    held = tally.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load"))
    numbers = tally.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    return numbers.join(held, "shard", "left").select("shard", F.coalesce("load", F.lit(0)).alias("load"))


def _moves(tally: DataFrame, total: int, shards: int, slack: float, turn: int) -> DataFrame:
    """(group, shard, to, n): how many members go from a shard to another in this round."""
    room = _loads(tally, shards).select("shard", (F.lit(int(total / shards * (1 + slack)) + 1) - F.col("load")).alias("room"))
    tie = F.xxhash64("h", "shard", F.lit(turn))  # what finds no quota one way may find it the other way
    held = F.struct((F.col("room") >= F.col("size")).alias("open"), "n", tie.alias("tie"), "shard")
    seen = tally.join(F.broadcast(room), "shard").groupBy(*GROUP).agg(F.collect_list(held).alias("_held")).where(F.size("_held") > 1)
    # as many entries as there are shards at most
    larger = lambda x: F.array_max(F.filter("_held", lambda y: F.struct(y["n"], y["tie"]) > F.struct(x["n"], x["tie"])))
    wishes = F.transform("_held", lambda x: F.struct(x["shard"].alias("shard"), larger(x)["shard"].alias("to"), x["n"].alias("n")))
    wanting = seen.select(*GROUP, F.inline(wishes)).where("to IS NOT NULL").withColumn("bytes", F.col("n") * F.col("size"))
    ways = wanting.groupBy("shard", "to").agg(F.sum("bytes").alias("there"))
    back = ways.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("there").alias("back"))
    share = F.floor(F.greatest(F.col("room"), F.lit(0)) / F.lit(max(1, shards - 1)))
    quota = ways.join(back, ["shard", "to"], "left").join(room.withColumnRenamed("shard", "to"), "to").select(
        "shard", "to", (F.least("there", F.coalesce("back", F.lit(0))) + share).alias("quota")
    )  # a row for each way between two shards
    # cells by powers of two of the bytes, so that the least come first, split by hash
    cell = F.floor(F.log2("bytes")) * (1 << CELL_BITS) + F.shiftrightunsigned("h", 64 - CELL_BITS)
    taken = _running(wanting.join(F.broadcast(quota), ["shard", "to"]), ["shard", "to"], cell, ["bytes", *GROUP], F.col("bytes"), "taken")
    may = F.least("n", F.floor(F.greatest(F.col("quota") - F.col("taken"), F.lit(0)) / F.col("size")))
    return taken.select(*GROUP, "shard", "to", may.cast("long").alias("n")).where("n > 0")


def _moved(tally: DataFrame, moves: DataFrame) -> DataFrame:
    off = moves.select(*GROUP, "shard", (-F.col("n")).alias("n"))
    on = moves.select(*GROUP, F.col("to").alias("shard"), "n")
    return tally.unionByName(off).unionByName(on).groupBy(*GROUP, "shard").agg(F.sum("n").alias("n")).where("n > 0")


def _followed(rows: DataFrame, tally: DataFrame) -> DataFrame:
    """The linked documents, dealt to shards as the tallies say, those that can stay where they are first."""
    ordered = F.array_sort(F.collect_list(F.struct("shard", "n")))
    ends = F.transform("_t", lambda x, i: F.struct(x["shard"].alias("shard"), F.aggregate(F.slice("_t", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("from")))
    stretches = tally.groupBy(*GROUP).agg(ordered.alias("_t")).select(*GROUP, ends.alias("_ends"))
    linked = rows.join(stretches.select(*GROUP), list(GROUP), "left_semi")
    placed = _running(linked, list(GROUP), F.col("first_shard") * SALTS + F.col("salt"), ["row"], F.lit(1), "_place").join(stretches, list(GROUP))
    return placed.withColumn("shard", F.element_at(F.filter("_ends", lambda e: e["from"] <= F.col("_place")), -1)["shard"]).drop("_place", "_ends")


def _filled(rows: DataFrame, tally: DataFrame, shards: int) -> DataFrame:
    """The other documents, in the room that linked ones leave."""
    alone = rows.join(tally.select(*GROUP).distinct(), list(GROUP), "left_anti")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"))
    left = F.greatest(F.lit(0.0), F.col("total") / shards - F.col("load"))
    room = _loads(tally, shards).crossJoin(F.broadcast(total)).select("shard", left.alias("left"))  # a row for each shard
    rooms = room.agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "left"))), lambda x: x["left"]).alias("_r"))
    own = alone.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("double").alias("_own"))
    sums = F.transform("_r", lambda _, i: F.aggregate(F.slice("_r", 1, i + 1), F.lit(0.0), lambda a, x: a + x))
    scaled = F.transform("_sums", lambda s: F.coalesce(F.try_divide(s * F.col("_own"), F.element_at("_sums", -1)), F.lit(0.0)))
    edges = rooms.crossJoin(own).withColumn("_sums", sums).select(scaled.alias("edges"))
    return _stretched(alone, edges, "shard")


def assigned(docs: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (gapless in a shard), grown_shard and first_shard of every document.

    ``first_shard`` is the label before the first round.
    """
    if shards < 1:
        raise ValueError("one shard at least")
    rows = staged(_placed(docs), "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    rows = staged(_stretched(rows, _even(rows, shards), "first_shard"), "first-shards")
    tally = staged(_tallies(rows.withColumnRenamed("first_shard", "shard")), "tallies")
    for turn in range(rounds):
        moves = staged(_moves(tally, total, shards, slack, turn), "moves")
        if moves.isEmpty():
            break
        tally = staged(_moved(tally, moves), "tallies")
    columns = ["row", "doc_id", "size", "crc", "first_shard", "shard"]
    placed = staged(_followed(rows, tally).select(*columns).unionByName(_filled(rows, tally, shards).select(*columns)), "shards")
    slots = _running(placed, ["shard"], F.pmod(F.xxhash64("row"), F.lit(1 << CELL_BITS)), ["row"], F.lit(1), "slot")
    return slots.select(
        "doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "first_shard",
    )


def cut_groups(shards: DataFrame, shard: str = "shard") -> DataFrame:
    """How many groups of equal texts lie in several shards, and the sizes of the shards: one row."""
    groups = shards.groupBy("text_crc32", "size").agg(F.min(shard).alias("a"), F.max(shard).alias("b"))
    loads = shards.groupBy(shard).agg(F.sum("size").alias("bytes"))
    return groups.agg(F.count_if(F.col("a") < F.col("b")).alias("cut")).crossJoin(loads.agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")))


def brute_force(rows: list[tuple], shards: int = SHARDS, slack: float = SLACK, rounds: int = ROUNDS) -> dict:
    """(text, shard) → how many of the rows (doc_id, text) of distinct doc_ids lie there, by replaying the rounds, for tests."""
    import math
    import zlib

    import xxhash

    def chained(*parts: bytes) -> int:
        seed = 42
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    long_, int_ = (lambda v: v.to_bytes(8, "little", signed=True)), (lambda v: v.to_bytes(4, "little", signed=True))
    docs = []
    for d, t in rows:
        raw = (t or "").encode()
        h, crc = chained(raw), zlib.crc32(raw)
        docs.append({"text": t or "", "size": len(raw) + 1, "h": h, "crc": crc, "u": chained(*([] if d is None else [long_(d)]), long_(h), long_(crc))})
    docs.sort(key=lambda x: (x["u"] % (1 << 64) >> 64 - CELL_BITS, x["u"], x["size"]))

    def stretch(some: list, ends: list[float], out: str) -> None:
        before = 0
        for x in some:
            x[out] = min(sum(e <= before + x["size"] / 2 for e in ends), len(ends) - 1)
            before += x["size"]

    total = sum(x["size"] for x in docs)
    stretch(docs, [k * float(total) / shards for k in range(1, shards + 1)], "first")
    groups: dict[str, list] = {}
    for x in docs:
        groups.setdefault(x["text"], []).append(x)
    tally = {t: {s: n for s in range(shards) if (n := sum(x["first"] == s for x in g))} for t, g in groups.items() if len(g) > 1}
    fact = {t: (g[0]["h"], g[0]["crc"], g[0]["size"]) for t, g in groups.items()}
    load = lambda s: sum(n.get(s, 0) * fact[t][2] for t, n in tally.items())
    for turn in range(rounds):
        room = {s: int(total / shards * (1 + slack)) + 1 - load(s) for s in range(shards)}
        wishes = []
        for t, held in tally.items():
            h, crc, size = fact[t]
            rank = {s: (room[s] >= size, n, chained(long_(h), int_(s), int_(turn)), s) for s, n in held.items()}
            for s in held if len(held) > 1 else ():
                more = [r for r in rank.values() if r[1:3] > rank[s][1:3]]
                if more:
                    wishes.append((s, max(more)[3], held[s] * size, h, crc, size, held[s], t))
        there: dict[tuple, int] = {}
        for s, to, size, *_ in wishes:
            there[s, to] = there.get((s, to), 0) + size
        taken: dict[tuple, int] = {}
        moves = []
        for s, to, much, h, crc, size, n, t in sorted(wishes, key=lambda w: (math.floor(math.log2(w[2])) * (1 << CELL_BITS) + (w[3] % (1 << 64) >> 64 - CELL_BITS), *w[2:6])):
            quota = min(there[s, to], there.get((to, s), 0)) + max(room[to], 0) // max(1, shards - 1)
            may = min(n, max(quota - taken.get((s, to), 0), 0) // size)
            taken[s, to] = taken.get((s, to), 0) + much
            if may:
                moves.append((t, s, to, may))
        if not moves:
            break
        for t, s, to, n in moves:
            tally[t][s] -= n
            tally[t][to] = tally[t].get(to, 0) + n
        tally = {t: {s: n for s, n in held.items() if n} for t, held in tally.items()}
    alone = [x for x in docs if x["text"] not in tally]
    left = [max(0.0, total / shards - load(s)) for s in range(shards)]
    own, ends = float(sum(x["size"] for x in alone)), [sum(left[: s + 1]) for s in range(shards)]
    stretch(alone, [e * own / ends[-1] if ends[-1] else 0.0 for e in ends], "shard")
    out = {(t, s): n for t, held in tally.items() for s, n in held.items()}
    return out | {(x["text"], x["shard"]): 1 for x in alone}
