"""Request chains: which captured call continues which.

The rule is sequential: in time order, a call continues a chain when exactly
one chain's last call leads to it; with none it starts a chain if it looks like
a start; else it stays uncorrelated.  It is computed here set-wise:

* Every way one call can lead to another is a shared *lineage key*: the response
  id it names, a tool call id it answers, or a context it extends.  A call offers
  keys and asks for keys; no pairs of calls are formed.
* A labelling (who continues whom) fixes during which time each call is the last
  of its chain.  Per key, an ordered scan over births, deaths and asks gives each
  ask the number of live offers and, if there is one, which.  That is one step of
  the rule for all calls at once.
* The rule has exactly one labelling that reproduces itself, because a call's
  label depends only on earlier calls.  Starting from "continues the latest call
  it shares a key with", mostly one step confirms it; contested groups of calls are
  settled in order, and the loop stops only where a step changes nothing.
* Chain roots and positions come from pointer doubling, in as many rounds as the
  logarithm of the longest chain.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.measure import available, kind_from_rank, kind_of, rank_of
from usagelake.functions.ordered import (
    BLOCK,
    Running,
    carry,
    last_value,
    lookup_join,
    number,
    running_max,
    running_sum,
    running_xor,
    small,
)
from usagelake.operators import chain_order
from usagelake.operators.gateway import MESSAGES, PROTOCOLS, RESPONSES, coverage_percent, is_model_call
from usagelake.session import cut, release, sizeless

# How a call continues another, strongest evidence first.
METHODS = ("explicit_id", "tool_lineage", "context_lineage")
LINEAGE_KINDS = ("history", "tool_result", "file")

CALL_COLUMNS = (
    "id", "profile", "protocol", "started_us", "model", "start_shape", "response_id", "previous_response_id",
    "tool_offers", "tool_asks", "lineage",
)


# ------------------------------------------------------- from captured requests

def start_shape() -> Column:
    """Does the request look like the start of a conversation?"""
    messages = F.exists(
        F.coalesce("request.metadata.anthropicMessages.messages", F.array()),
        lambda m: (m["role"] == "user") & F.exists(F.coalesce(m["blocks"], F.array()), lambda b: b["type"] != "tool_result"))
    items = F.exists(
        F.coalesce("request.metadata.openaiResponses.items", F.array()),
        lambda i: (i["type"] == "message") & ((F.coalesce(i["itemId"], F.lit("")) != "") | (i["index"] == 0)))
    return F.when(F.col("protocol") == MESSAGES, messages).when(F.col("protocol") == RESPONSES, items).otherwise(F.lit(False))


def shaped_like_start(calls: DataFrame) -> DataFrame:
    """Calls with their start shape as ``shape`` (captured schema or already reduced)."""
    shape = F.col("start_shape") if "start_shape" in calls.columns else start_shape()
    return calls.withColumn("shape", F.coalesce(shape, F.lit(False)))


def _block_ids(role: str, field: str) -> Column:
    chosen = F.filter(F.coalesce("request.metadata.anthropicMessages.messages", F.array()), lambda m: m["role"] == role)
    ids = F.flatten(F.transform(chosen, lambda m: F.transform(F.coalesce(m["blocks"], F.array()), lambda b: b[field])))
    return F.array_distinct(F.filter(ids, lambda i: F.coalesce(i, F.lit("")) != ""))


def calls_from_exchanges(exchanges: DataFrame) -> DataFrame:
    """The chain-relevant facts of captured model calls (nested capture schema).

    Other calls (listings, token counts, reads) are no part of any chain.
    """
    empty = F.array().cast("array<string>")
    hashes = F.transform(
        F.filter(F.coalesce("request.components", F.array()),
                 lambda c: c["kind"].isin(*LINEAGE_KINDS) & (F.coalesce(c["contentHash"], F.lit("")) != "")),
        lambda c: c["contentHash"])
    messages = F.col("protocol") == MESSAGES

    def ids(name: str) -> Column:
        return F.array_distinct(F.filter(F.coalesce(name, empty), lambda i: i != ""))

    return exchanges.where(is_model_call("request.method", "request.endpoint")).select(
        "id", "profile", "protocol", F.unix_micros("startedAt").alias("started_us"),
        F.coalesce("model", F.lit("")).alias("model"), F.coalesce(start_shape(), F.lit(False)).alias("start_shape"),
        F.when(~messages, F.col("response.openaiResponses.responseId")).alias("response_id"),
        F.when(~messages, F.col("request.metadata.openaiResponses.previousResponseId")).alias("previous_response_id"),
        F.when(messages, _block_ids("assistant", "toolUseId"))
        .otherwise(ids("response.openaiResponses.outputItemCallIDs")).alias("tool_offers"),
        F.when(messages, _block_ids("user", "toolResultToolUseId"))
        .otherwise(ids("request.metadata.openaiResponses.functionCallOutputIds")).alias("tool_asks"),
        hashes.alias("lineage"))


# ------------------------------------------------------------- lineage keys

#: A lineage key: evidence, protocol and profile, and the id or hash itself.
KEY = ("method", "scope", "value")

#: Keys are dealt into so many parts, to learn at little cost that no key has more rows than a block.
PARTS = 1 << 16


def part_of() -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(PARTS))


@dataclass
class Lineage:
    """Numbered calls and the keys they offer and ask for.

    ``filed`` has, of each call with a context, the set's digest ``sig`` and the hash that the set is ``filed`` under
    (None where contexts are left out).  Keys are spelled out where they are scanned and not kept.
    """

    nodes: DataFrame
    filed: DataFrame | None
    #: What ``crowded`` gave for all keys, by the block.
    known: dict[int, DataFrame | None] = field(default_factory=dict)

    def offered(self, of: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        """Keys offered, by the calls ``of`` only where given (n and the columns to ``keep``)."""
        out = self._spelled(of, keep, _one("response_id"), _list("tool_offers"))
        if self.filed is None:
            return out
        filed = self.filed if of is None else self.filed.join(of.select("n", *keep), "n")
        return out.unionByName(_keys(filed, (CONTEXT, F.array("filed")), keep=keep))

    def asked(self, of: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
        contexts = [] if self.filed is None else [F.col("lineage")]
        return self._spelled(of, keep, _one("previous_response_id"), _list("tool_asks"), *contexts)

    def _spelled(self, of: DataFrame | None, keep: tuple[str, ...], *values: Column) -> DataFrame:
        nodes = self.nodes if of is None else self.nodes.join(of.select("n", *keep), "n")
        return _keys(nodes, *enumerate(values), keep=keep)

    def among(self, ids: DataFrame) -> Lineage:
        """The calls ``ids`` and no others."""
        filed = None if self.filed is None else cut(self.filed.join(ids, "n", "left_semi"))
        return Lineage(cut(self.nodes.join(ids, "n", "left_semi")), filed, self.known)

    @property
    def offers(self) -> DataFrame:
        """Offers under each of their marks, ``_v``: those of calls that fit share key and mark."""
        return self.offered().withColumn("_v", F.explode(_variants(True)))

    @property
    def asks(self) -> DataFrame:
        return self.asked().withColumn("_v", F.explode(_variants(False)))

    def crowded_of_all(self, block: int) -> DataFrame | None:
        """``crowded`` of all keys: found out once, and enough for the keys of some calls too."""
        if block not in self.known:
            self.known[block] = self.crowded(self.offered(), self.asked(), block)
        return self.known[block]

    def crowded(self, offers: DataFrame, asks: DataFrame, block: int) -> DataFrame | None:
        """Parts of the keys in which a key may have more rows than a block, if there are any."""
        rows = offers.select(*KEY, F.lit(2).alias("_w")).unionByName(asks.select(*KEY, F.lit(1).alias("_w")))
        large = cut(rows.groupBy(part_of().alias("_part")).agg(F.sum("_w").alias("_w")).where(F.col("_w") > block).select("_part"))
        return None if large.isEmpty() else large


def _one(name: str) -> Column:
    return F.array(F.coalesce(F.col(name), F.lit("")))


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def _variants(offering: bool) -> Column:
    """Marks by model, so that calls of different named models never share a key and a mark."""
    named = F.concat(F.lit("="), F.col("model"))
    blank = F.col("model") == ""
    if offering:
        return F.when(blank, F.array(F.lit("-"))).otherwise(F.array(named, F.lit("*")))
    return F.when(blank, F.array(F.lit("*"), F.lit("-"))).otherwise(F.array(named, F.lit("-")))


def _varied(offers: DataFrame, asks: DataFrame, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Offers and asks under each of their marks, of the given keys only."""
    if keys is not None:
        offers = lookup_join(offers, keys, KEY, "left_semi")
    return (offers.withColumn("_v", F.explode(_variants(True))), asks.withColumn("_v", F.explode(_variants(False))))


def _keys(calls: DataFrame, *values: tuple[int, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each (method, value) of a call; all methods in one pass, so what is joined to calls moves once."""
    def tagged(method: int, of: Column) -> Column:
        return F.transform(F.array_distinct(of), lambda v: F.struct(F.lit(method).alias("method"), v.alias("value")))

    every = F.concat(*[tagged(method, of) for method, of in values])
    rows = calls.select("n", "model", "scope", *keep, F.explode(every).alias("_k"))
    return rows.select("n", "model", "scope", *keep, "_k.value", "_k.method").where("value <> ''")


def lineage(calls: DataFrame, context: bool = True) -> Lineage:
    """Number the calls in time order and spell out their lineage keys.

    A context extends another when it holds all its hashes and more.  Each distinct set is filed under its rarest
    hash, which every set that extends it holds too: a call offers the hash that its set is filed under and asks for
    each of its own.  So asks are as many as hashes, however many sets contain each other; whether the set that an
    ask meets is really contained is looked at where one is met.
    """
    sets = F.array_sort(F.array_distinct(F.filter(
        F.coalesce("lineage", F.array().cast("array<string>")), lambda h: F.coalesce(h, F.lit("")) != "")))
    slim = calls.where(F.col("protocol").isin(*PROTOCOLS)).select(*CALL_COLUMNS).withColumns(
        {"model": F.coalesce("model", F.lit("")), "lineage": sets})
    nodes = number(slim, ["started_us", "id"], "n").withColumn("scope", F.concat_ws("|", "protocol", "profile"))
    if not context:
        return Lineage(nodes, None)
    # The numbered calls are kept already: what is found out about their contexts is kept beside them, not with them again.
    having = nodes.where(F.size("lineage") > 0).withColumn("sig", F.unhex(F.sha2(F.array_join("lineage", "\n"), 256)))
    held = having.groupBy("scope", "sig").agg(F.min("n").alias("set"), F.first("lineage").alias("lineage"))
    # A set goes by its first call's number here: digests would be most of what moves.
    members = held.select("scope", "set", F.explode("lineage").alias("h"))
    uses = members.groupBy("scope", "h").agg(F.count("set").alias("uses"))
    rarest = lookup_join(members, uses, ["scope", "h"]).groupBy("set").agg(F.min_by("h", F.struct("uses", "h")).alias("filed"))
    named = held.select("scope", "sig", "set").join(rarest, "set").drop("set")
    return Lineage(nodes, cut(lookup_join(having.select("n", "scope", "model", "sig"), named, ["scope", "sig"], "inner")))


CONTEXT = METHODS.index("context_lineage")


def _contained(pairs: DataFrame, found: Lineage) -> DataFrame:
    """The (n, other) whose call ``n`` holds all hashes of the call ``other`` and more."""
    mine = found.nodes.select("n", F.col("lineage").alias("_have"))
    theirs = found.nodes.select(F.col("n").alias("other"), F.col("lineage").alias("_need"))
    both = lookup_join(lookup_join(pairs, mine, ["n"], "inner"), theirs, ["other"], "inner")
    inside = (F.size("_need") < F.size("_have")) & (F.size(F.array_except("_need", "_have")) == 0)
    return both.where(inside).drop("_have", "_need")


def _by_set(asked: DataFrame, found: Lineage) -> tuple[DataFrame, DataFrame]:
    """Offers and asks by whole sets, for the few asks (n, value: a hash) whose hash does not settle the matter.

    The sets filed under the hash are looked at one by one; an ask is left for each that is really contained.
    """
    holders = found.filed
    rows = asked.select("n", F.col("value").alias("filed")).distinct().join(found.nodes.select("n", "scope"), "n")
    filed = holders.groupBy("scope", "filed", "sig").agg(F.min("n").alias("other"))
    wanted = _contained(lookup_join(rows, filed, ["scope", "filed"], "inner").select("n", "other", "sig"), found)
    calls = found.nodes.select("n", "scope", "model")
    asks = _keys(wanted.select("n", F.hex("sig").alias("_sig")).join(calls, "n"), (CONTEXT, F.array("_sig")))
    offering = lookup_join(holders.select("n", "scope", "model", "sig"), wanted.select("sig").distinct(), ["sig"], "left_semi")
    return _keys(offering, (CONTEXT, F.array(F.hex("sig")))), asks


def _scan(rows: DataFrame, keys: tuple[str, ...], values: dict[str, Running], block: int, large: DataFrame | None,
          ask: Column) -> DataFrame:
    """``carry`` for asks among offers: by blocks only in the parts where a key may have more rows than one."""
    of_ask = {"keep": ask}
    if large is None:
        return carry(rows, keys, "ord", values, block, top=0, **of_ask)
    dealt = rows.withColumn("_part", part_of()).join(F.broadcast(large.withColumn("_large", F.lit(True))), "_part", "left")
    few = dealt.where("_large IS NULL").select(*rows.columns)
    many = dealt.where("_large").select(*rows.columns)
    return carry(few, keys, "ord", values, block, top=0, **of_ask).unionByName(carry(many, keys, "ord", values, block, **of_ask))


def _latest_by(offers: DataFrame, asks: DataFrame, keys: tuple[str, ...], block: int, large: DataFrame | None) -> DataFrame:
    """Asks that an earlier offer meets under ``keys``, with the latest one and whether the models fit.

    Only the order moves with a key: calls and sides are read off it.
    """
    born, ask = F.col("ord") % 2 == 1, F.col("ord") % 2 == 0
    rows = offers.select(*keys, "model", (F.col("n") * 2 + 1).alias("ord")).unionByName(
        asks.select(*keys, "model", (F.col("n") * 2).alias("ord")))
    last = F.when(born, F.struct(F.shiftright("ord", 1).alias("n"), F.col("model").alias("model")))
    # The latest offer of any model mostly fits; where it does not, calls meet under marks of their models.
    fits = (F.col("model") == "") | (F.col("_last.model") == "") | (F.col("model") == F.col("_last.model"))
    return _scan(rows, keys, {"_last": last_value(last)}, block, large, ask).where("_last IS NOT NULL").select(
        *KEY, F.shiftright("ord", 1).alias("n"), "model", F.col("_last.n").alias("previous"), fits.alias("_fits"))


def _latest(found: Lineage, offers: DataFrame, asks: DataFrame, block: int) -> DataFrame:
    """(n, value, previous): the latest earlier call that offers a value asked for.  See ``_one_each``."""
    large = found.crowded(offers, asks, block)
    hits = cut(_latest_by(offers, asks, KEY, block, large))
    sure, unsure = hits.where("_fits"), hits.where("NOT _fits")
    if not unsure.isEmpty():
        sure = sure.unionByName(_latest_by(*_varied(offers, unsure, unsure.select(*KEY).distinct()), (*KEY, "_v"), block, large))
    return sure.select("n", "value", "previous")


def _one_each(met: DataFrame) -> DataFrame:
    """A value may be met under two marks; the later offer counts."""
    return met.groupBy("n", "value").agg(F.max("previous").alias("previous"))


def latest_predecessor(calls: DataFrame, method: str, block: int = BLOCK) -> DataFrame:
    """Per call the latest earlier call it could continue by one kind of evidence.

    ``shared`` counts the keys (response id, tool ids or contexts) that lead to it.
    """
    rank = METHODS.index(method)
    found = lineage(calls, context=rank == CONTEXT)
    of = F.col("method") == rank
    met = _one_each(_latest(found, found.offered().where(of), found.asked().where(of), block))
    if rank < CONTEXT:
        best = met
    else:
        # The latest call filed under a hash mostly is contained.  Where it is not, the sets filed there are asked for.
        met = cut(met)
        sure = cut(_contained(met.withColumn("other", F.col("previous")), found).drop("other"))
        rest = cut(met.join(sure.select("n", "value"), ["n", "value"], "left_anti"))
        best = sure
        if not rest.isEmpty():
            best = sure.unionByName(_one_each(_latest(found, *_by_set(rest, found), block)))
    counted = best.groupBy("n", "previous").agg(F.count("*").alias("shared")).groupBy("n").agg(
        F.max(F.struct("previous", "shared")).alias("p"))
    names = found.nodes.select("n", "id")
    return counted.select("n", "p.previous", "p.shared").join(names, "n").join(
        names.select(F.col("n").alias("previous"), F.col("id").alias("previous_id")), "previous").select(
        "id", "previous_id", "shared")


# ------------------------------------------------------------ chain building

def _guess(found: Lineage, block: int) -> DataFrame:
    """Each call with the latest call that it shares a key with; one row a call is kept, however many keys it has."""
    offers, asks, large = found.offered(), found.asked(), found.crowded_of_all(block)
    best = cut(_latest_by(offers, asks, KEY, block, large).groupBy("n").agg(
        F.max(F.when(F.col("_fits"), F.col("previous"))).alias("parent"), (~F.bool_and("_fits")).alias("open")))
    again = best.where("open").select("n")
    best = best.select("n", "parent")
    if not again.isEmpty():
        unsure = found.asked(again)
        marked = _latest_by(*_varied(offers, unsure, unsure.select(*KEY).distinct()), (*KEY, "_v"), block, large)
        best = best.unionByName(marked.select("n", F.col("previous").alias("parent"))).groupBy("n").agg(F.max("parent").alias("parent"))
    return found.nodes.select("n", "start_shape").join(best, "n", "left").withColumn("torn", F.lit(False))


def _paths(labels: DataFrame) -> DataFrame:
    """Root and distance of every call under a labelling, by pointer doubling.

    Of several calls that claim one predecessor the first has it.  A call is in a
    chain when it or a call it continues, without a break between, looks like a start.
    """
    first = labels.where("parent IS NOT NULL").groupBy("parent").agg(F.min("n").alias("_child"))
    held = first.select(F.col("_child").alias("n"), F.lit(True).alias("_held"))
    begins = F.col("start_shape") & ~F.col("torn")
    state = sizeless(cut(labels.join(held, "n", "left").select(
        "n", "torn", F.when(F.col("_held"), F.col("parent")).alias("parent"),
        F.when(F.col("_held"), F.col("parent")).alias("up"),
        F.lit(1).cast("long").alias("reach"),
        F.when(begins, F.col("n")).alias("root"), F.when(begins, F.lit(0).cast("long")).alias("dist"))))
    while not state.where("up IS NOT NULL").isEmpty():
        for _ in range(2):
            above = state.select(
                F.col("n").alias("up"), F.col("up").alias("_up"), F.col("reach").alias("_reach"),
                F.col("root").alias("_root"), F.col("dist").alias("_dist"))
            # Each call is above at most one other at every distance: no hot key.
            joined = state.join(above, "up", "left")
            further = F.col("_root").isNotNull()
            state = joined.select(
                "n", "torn", "parent", F.col("_up").alias("up"),
                (F.col("reach") + F.coalesce("_reach", F.lit(0))).alias("reach"),
                F.when(further, F.col("_root")).otherwise(F.col("root")).alias("root"),
                F.when(further, F.col("reach") + F.col("_dist")).otherwise(F.col("dist")).alias("dist"))
        state = sizeless(cut(state))
    return state


def _alive_by(offers: DataFrame, asks: DataFrame, keys: tuple[str, ...], block: int, large: DataFrame | None) -> DataFrame:
    """Asks that a live offer meets under ``keys``: how many (``alive``, 2 at most), which, and whether all models fit."""
    kind = F.col("ord") % 3
    ends = F.array((F.col("n") * 3 + 2), (F.col("death") * 3 + 1))
    moves = offers.select(*keys, F.explode(ends).alias("ord"), F.col("n").alias("x"), "model").where("ord IS NOT NULL")
    asked = asks.select(*keys, (F.col("n") * 3).alias("ord"), F.lit(0).cast("long").alias("x"), "model")
    named = F.when((kind != 0) & (F.col("model") != ""), F.col("model"))
    met = _scan(moves.unionByName(asked), keys, {
        "alive": running_sum(F.when(kind == 2, 1).when(kind == 1, -1).otherwise(0).cast("long")), "which": running_xor(F.col("x")),
        "_least": Running("min", named), "_most": running_max(named)}, block, large, kind == 0).where("alive > 0")
    # Calls of one model, or of none, all fit each other; where models differ, calls meet under marks of their models.
    fits = (F.col("model") == "") | F.col("_least").isNull() | (
        (F.col("_least") == F.col("model")) & (F.col("_most") == F.col("model")))
    return met.select(F.call_function("div", F.col("ord"), F.lit(3)).alias("n"), "method", "value",
                      F.least("alive", F.lit(2).cast("long")).alias("alive"), "which", fits.alias("_fits"))


def _alike(met: DataFrame, fits: Column) -> DataFrame:
    """What asks tell, once: most of a call's keys lead to one call.  A value is told where several sets are filed there."""
    told = (F.col("method") == CONTEXT) & (F.col("alive") > 1)
    tell = {"method": F.col("method"), "value": F.when(told, F.col("value")), "alive": F.col("alive"),
            "which": F.when(F.col("alive") == 1, F.col("which"))}
    return met.select("n", *[F.when(fits, c).alias(name) for name, c in tell.items()]).distinct()


def _alive(offers: DataFrame, asks: DataFrame, block: int, large: DataFrame | None) -> DataFrame:
    """What asks tell that meet a live offer: (n, method, value, alive, which), ``which`` being the call if it is one.

    ``offers`` are those of living calls, with their ``death``.
    """
    met = cut(_alike(_alive_by(offers, asks, KEY, block, large), F.col("_fits")))
    sure, unsure = met.where("method IS NOT NULL"), met.where("method IS NULL").select("n")
    if unsure.isEmpty():
        return sure
    # All keys of a call one of whose keys reached another model.
    asks = asks.join(unsure, "n", "left_semi")
    again = _alive_by(*_varied(offers, asks, asks.select(*KEY).distinct()), (*KEY, "_v"), block, large)
    return cut(sure.unionByName(_alike(again, F.lit(True))))


def _components(found: Lineage, paths: DataFrame) -> DataFrame:
    """(n, comp): groups of calls that lineage keys may join, by a call of theirs.

    The calls of one chain share keys already, so only keys that reach more than one chain join anything: these are
    few, and each joins its chains to the least of them.  Each round every chain steps to its least neighbour and the
    links are drawn again between the places stepped to, so rounds are few whatever the shape of a group.
    """
    tops = cut(paths.select("n", F.coalesce("root", "n").alias("top")))
    keys = [*KEY, "_v"]

    def marked(*of) -> DataFrame:
        sides = (found.offered(*of), 1, True), (found.asked(*of), 0, False)
        one, two = (rows.withColumns({"_v": F.explode(_variants(offering)), "o": F.lit(o)}) for rows, o, offering in sides)
        return one.unionByName(two).withColumn("_h", F.xxhash64(*keys))

    def across(rows: DataFrame, keys: list[str]) -> DataFrame:
        return rows.groupBy(*keys).agg(
            F.min("top").alias("a"), F.max("top").alias("_most"), F.max("o").alias("_any"), F.min("o").alias("_all")).where(
            "_any > _all AND a < _most").select(*keys, "a")

    # All keys are gone through by their hashes; the few that may reach another chain are then looked at themselves.
    few = small(cut(across(marked(tops, ("top",)), ["_h"]).select("_h")))
    met = cut(lookup_join(marked(), few, ["_h"], "left_semi").join(tops, "n").select("top", "o", *keys))
    links = cut(lookup_join(met.select("top", *keys), small(cut(across(met, keys))), keys, "inner").where("top <> a").select(
        "a", F.col("top").alias("b")).distinct())
    labels = None
    while not links.isEmpty():
        least = links.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("to"))
        lone = links.select(F.col("a").alias("n")).distinct().withColumn("to", F.col("n"))
        step = cut(least.unionByName(lone).groupBy("n").agg(F.min("to").alias("to")))
        if labels is None:
            labels = step.select("n", F.col("to").alias("comp"))
        else:
            moved = lookup_join(labels, step.select(F.col("n").alias("comp"), "to"), ["comp"])
            labels = cut(moved.select("n", F.coalesce("to", "comp").alias("comp")))
        one = lookup_join(links, step.select(F.col("n").alias("a"), F.col("to").alias("_a")), ["a"], "inner")
        two = lookup_join(one, step.select(F.col("n").alias("b"), F.col("to").alias("_b")), ["b"], "inner")
        links = cut(two.where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    if labels is None:
        return tops.select("n", F.col("top").alias("comp"))
    joined = small(cut(labels.select(F.col("n").alias("top"), "comp")))
    return lookup_join(tops, joined, ["top"]).select("n", F.coalesce("comp", "top").alias("comp"))


#: Calls of a contested group that one task may settle in order.
GROUP_CALLS = 50_000


def _settled(found: Lineage, groups: DataFrame, contested: DataFrame, limit: int) -> DataFrame:
    """Labels of the calls of contested groups of at most ``limit`` calls, by the sequential rule.

    Groups share no key, so each is a world of its own.
    """
    torn = contested.join(groups, "n").select("comp").distinct()
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size")).where(F.col("size") <= limit)
    chosen = sizes.join(torn, "comp").select("comp")
    filed = found.nodes.select("n", F.lit(None).cast("string").alias("filed")).limit(0) if found.filed is None else found.filed.select("n", "filed")
    rows = lookup_join(groups, chosen, ["comp"], "left_semi").join(found.nodes, "n").join(filed, "n", "left").select(
        "comp", "n", "model", "start_shape", "response_id", "previous_response_id", "tool_offers", "tool_asks", "lineage", "filed")
    return rows.repartition("comp").sortWithinPartitions("comp", "n").mapInArrow(chain_order.in_order, chain_order.LABELS)


def _step(found: Lineage, paths: DataFrame, block: int) -> DataFrame:
    """Apply the rule once: new labels, each with the strongest ``method`` that it rests on."""
    chained = paths.where("root IS NOT NULL").select("n", "parent", "dist")
    # The root of a chain claims nobody, whatever its pointer says.
    deaths = chained.where("parent IS NOT NULL AND dist > 0").select(F.col("parent").alias("n"), F.col("n").alias("death"))
    living = chained.select("n").join(deaths, "n", "left")
    scanned = _alive(found.offered(living, ("death",)), found.asked(), block, found.crowded_of_all(block))
    single = (F.col("method") < CONTEXT) | (F.col("alive") == 1)
    known = scanned.where(F.col("method") < CONTEXT).unionByName(
        _contained(scanned.where((F.col("method") == CONTEXT) & single).withColumn("other", F.col("which")), found).drop("other"))
    crowded = scanned.where(~single)
    if not crowded.isEmpty():
        # Several live calls are filed under one hash: which of their sets are contained?
        by_set, asks = _by_set(crowded, found)
        known = known.unionByName(_alive(by_set.join(living, "n"), asks, block, found.crowded(by_set, asks, block)))
    judged = known.groupBy("n").agg(
        ((F.max("alive") > 1) | (F.min("which") != F.max("which"))).alias("torn"), F.min("which").alias("parent"),
        F.min("method").alias("method"))
    claims = ~F.col("torn")
    return cut(found.nodes.select("n", "start_shape").join(judged, "n", "left").select(
        "n", "start_shape", F.when(claims, F.col("parent")).alias("parent"), F.coalesce("torn", F.lit(False)).alias("torn"),
        F.when(claims, F.col("method")).alias("method")))


@dataclass
class Chains:
    """Calls in chains, links with their method, evidence rows, and the rest.

    A chain is known by ``root_id``, the id of its first call.  ``chain_id`` is a label to show: a part of the
    root's id, and not unique.
    """

    members: DataFrame
    links: DataFrame
    evidence: DataFrame
    uncorrelated: DataFrame
    #: Steps taken until the labelling reproduced itself.
    rounds: int = 0
    #: Calls of the longest chain.
    longest: int = 0


def chain_id(root: Column) -> Column:
    bare = F.when(root.startswith("gw-"), F.substr(root, F.lit(4))).otherwise(root)
    tail = F.when(F.length(bare) > 12, F.right(bare, F.lit(12))).otherwise(bare)
    return F.concat(F.lit("gwc-"), F.when(tail == "", "unknown").otherwise(tail))


def _changed(labels: DataFrame, paths: DataFrame) -> DataFrame:
    """Calls whose label is not the one that the paths rest on."""
    settled = paths.select(
        "n", F.when(F.col("dist") > 0, F.col("parent")).alias("_was"), F.col("torn").alias("_torn"))
    return cut(labels.join(settled, "n").where(
        ~(F.col("parent").eqNullSafe(F.col("_was")) & (F.col("torn") == F.col("_torn")))).select("n"))


def build_chains(calls: DataFrame, block: int = BLOCK, context: bool = True, group_calls: int = GROUP_CALLS) -> Chains:
    """Chains of model calls.  Call ids must be unique.

    Where the first labelling does not reproduce itself, the groups of calls that keys may join are found, and each
    contested one of at most ``group_calls`` is settled in one ordered pass; the second step then confirms it.  Only
    larger groups take further steps, at least one earlier call of each being settled for good in each.  Steps after
    the first read the contested groups and no other calls.
    """
    found = lineage(calls, context)
    paths = _paths(_guess(found, block))
    labels = _step(found, paths, block)
    changed, rounds = _changed(labels, paths), 1
    if not changed.isEmpty():
        # Groups without a changed call reproduce themselves and are done: the others go on alone.
        groups = _components(found, paths)
        comps = small(cut(changed.join(groups, "n").select("comp").distinct()))
        torn = cut(lookup_join(groups, comps, ["comp"], "left_semi"))
        ids = small(torn).select("n")
        part = found.among(ids)
        sure = cut(_settled(part, torn, changed, group_calls))
        done = [rows.join(ids, "n", "left_anti") for rows in (paths, labels)]
        known = labels.drop("method").join(ids, "n", "left_semi").join(sure.select("n"), "n", "left_anti")
        labels = cut(known.unionByName(sure.join(part.nodes.select("n", "start_shape"), "n")))
        while not changed.isEmpty():
            paths = _paths(labels)
            labels = _step(part, paths, block)
            changed, rounds = _changed(labels, paths), rounds + 1
        paths, labels = (old.unionByName(new) for old, new in zip(done, (paths, labels), strict=True))
    names = found.nodes.select("n", "id", "profile", "protocol", "started_us", "model")
    begun = paths.where("dist = 0").select("n")
    roots = names.join(begun, "n", "left_semi").select(F.col("n").alias("root"), F.col("id").alias("root_id"))
    chained = paths.where("root IS NOT NULL").join(names, "n")
    # The calls of one long chain all look up one root: spread them.
    starts = chained.where("dist = 0").withColumn("root_id", F.col("id"))
    later = lookup_join(chained.where("dist > 0"), roots, ["root"], "inner")
    members = starts.unionByName(later).select(
        "root_id", chain_id(F.col("root_id")).alias("chain_id"), (F.col("dist") + 1).alias("call"), "id", "profile", "protocol", "started_us", "model", "n",
        F.when(F.col("dist") > 0, F.col("parent")).alias("parent"))
    best = labels.where("parent IS NOT NULL").select("n", F.col("method").alias("_m"))
    method = F.lit("chain_start")
    for rank, name in enumerate(METHODS):
        method = F.when(F.col("_m") == rank, name).otherwise(method)
    previous = names.select(F.col("n").alias("parent"), F.col("id").alias("previous_id"))
    links = members.join(best, "n", "left").join(previous, "parent", "left").select(
        "root_id", "chain_id", "call", "id", "previous_id",
        F.when(F.col("previous_id").isNull(), "start").otherwise("continue").alias("relation"), method.alias("method"))
    kind = F.lit("")
    for rank, name in enumerate(METHODS):
        kind = F.when(F.col("_m") == rank, name).otherwise(kind)
    # What both calls of a link name: read off the calls themselves, so no met key is kept for it.
    linked = members.where("parent IS NOT NULL").select("n", "parent").join(best, "n").join(
        found.nodes.select("n", "id", "previous_response_id", "tool_asks"), "n").join(
        found.nodes.select(F.col("n").alias("parent"), F.col("id").alias("previous_id"), "tool_offers"), "parent")
    values = F.when(F.col("_m") == 0, _one("previous_response_id")).when(
        F.col("_m") == 1, F.filter(F.array_intersect(_list("tool_asks"), _list("tool_offers")), lambda t: t != "")).otherwise(
        F.array(F.lit("component_hashes")))
    evidence = linked.select("id", "previous_id", kind.alias("kind"), F.explode(values).alias("value"))
    rest = paths.where("root IS NULL").select("n").join(names, "n").drop("n")
    longest = (paths.agg(F.max("dist")).head()[0] or 0) + 1
    release(paths.sparkSession)
    return Chains(members.drop("n", "parent"), links, evidence, rest, rounds, longest)


# ------------------------------------------------------------- chain reports

def context_deltas(calls: DataFrame, block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """Context of each call less that of the call before it in its chain.

    ``calls`` has root_id, chain_id, call (1, 2, ...), attributed and its kind.  The first
    call's delta is unknown; falls and zeros are kept.  ``longest``, where known, is the length of the longest
    chain: one shorter than a block is scanned whole.
    """
    with_before = carry(calls, ["root_id"], "call", {
        "_p": last_value(F.struct(F.col("attributed").alias("value"), F.col("attributed_kind").alias("kind")))}, block, top=longest)
    before = with_before.withColumns({"before": F.col("_p.value"), "before_kind": F.col("_p.kind")})
    both = available("attributed") & available("before")
    weaker = kind_from_rank(F.greatest(rank_of(kind_of("attributed")), rank_of(kind_of("before"))))
    return before.select(
        *calls.columns, F.when(both, F.col("attributed") - F.col("before")).alias("context_delta"),
        F.when(both, weaker).otherwise("unknown").alias("context_delta_kind"))


# Provider usage fields a chain adds up.
CHAIN_USAGE = ("total_input", "cached_input", "fresh_input", "cache_creation_input", "output", "reasoning_output")
GROWTH = ("tool_result", "history", "tool_definition")


def chain_usage(calls: DataFrame) -> DataFrame:
    """A field has a total only when every call of the chain reports it."""
    whole = F.count("*")
    some = F.lit(False)
    for field in CHAIN_USAGE:
        some = some | F.col(field).isNotNull()
    return calls.groupBy("root_id").agg(
        whole.alias("usage_total_calls"), F.count_if(some).alias("usage_observed_calls"),
        *[F.when(F.count(field) == whole, F.sum(field)).alias(f"provider_{field}") for field in CHAIN_USAGE])


def chain_metrics(deltas: DataFrame) -> DataFrame:
    """Initial, final, peak and total context, growth, and the call that grew most.

    One unknown call leaves peak and total unknown; one unknown step leaves the
    largest growth unknown.  All are plain aggregates.
    """
    ok = available("attributed")
    every = F.count_if(ok) == F.count("*")
    later = F.col("call") > 1
    step = F.col("context_delta")
    steps_known = F.count_if(later & step.isNull()) == 0
    top = F.max(F.when(later, step))
    weakest = kind_from_rank(F.max(F.when(ok, rank_of(kind_of("attributed")))))

    def at(name: str, last: bool) -> Column:
        pick = F.max_by if last else F.min_by
        return pick(F.struct(F.col(name).alias("v"), F.col(f"{name}_kind").alias("k")), F.col("call"))

    grouped = deltas.groupBy("root_id").agg(
        F.first("chain_id").alias("chain_id"), F.count("*").alias("model_calls"), F.min("started_us").alias("started_us"),
        F.min_by("model", "call").alias("model"), F.min_by("profile", "call").alias("profile"),
        F.min_by("protocol", "call").alias("protocol"),
        F.when(every, F.sum("attributed")).alias("total_context"),
        F.when(every, F.max("attributed")).alias("peak_context"),
        F.when(every, weakest).alias("_all_kind"),
        at("attributed", False).alias("_first"), at("attributed", True).alias("_last"),
        F.when(steps_known, top).alias("_top"),
        # The first call with the largest step.
        F.max_by("call", F.when(later & step.isNotNull(), F.struct(step, -F.col("call")))).alias("_top_call"),
        *[c for g in GROWTH for c in (at(g, False).alias(f"_first_{g}"), at(g, True).alias(f"_last_{g}"))])

    def known(side: str) -> Column:
        return F.when(F.coalesce(~F.col(f"{side}.k").isin("", "unknown"), F.lit(False)), F.col(f"{side}.v"))

    growth = known("_last") - known("_first")
    return grouped.select(
        "root_id", "chain_id", "profile", "protocol", "model", "started_us", "model_calls",
        known("_first").alias("initial_context"), known("_last").alias("final_context"),
        "peak_context", "total_context", F.coalesce("_all_kind", F.lit("unknown")).alias("total_context_kind"),
        growth.alias("context_growth"),
        F.when(F.col("_top") > 0, F.col("_top")).when(F.col("_top").isNotNull(), F.lit(0)).cast("long").alias("largest_growth"),
        F.when(F.col("_top") > 0, F.col("_top_call")).otherwise(0).cast("long").alias("largest_growth_call"),
        *[(known(f"_last_{g}") - known(f"_first_{g}")).alias(f"{g}_growth") for g in GROWTH])


def call_report(calls: DataFrame, block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """One row per call of a chain: its context, step, provider usage, gap and coverage."""
    deltas = context_deltas(calls, block, longest)
    both = F.col("total_input").isNotNull() & available("attributed")
    return deltas.withColumns({
        "attribution_gap": F.when(both, F.col("total_input") - F.col("attributed")),
        "coverage_percent": F.when(both, coverage_percent(F.col("attributed"), F.col("total_input"))),
    })


def chain_report(calls: DataFrame, block: int = BLOCK, longest: int | None = None) -> DataFrame:
    """One row per chain: context metrics, provider usage, gap and coverage; newest first."""
    metrics = chain_metrics(context_deltas(calls, block, longest))
    joined = metrics.join(chain_usage(calls), "root_id")
    both = F.col("provider_total_input").isNotNull() & F.col("total_context").isNotNull()
    return joined.withColumns({
        "attribution_gap": F.when(both, F.col("provider_total_input") - F.col("total_context")),
        "coverage_percent": F.when(both, coverage_percent(F.col("total_context"), F.col("provider_total_input"))),
    }).orderBy(F.col("started_us").desc(), "chain_id", "root_id")

