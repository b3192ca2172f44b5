"""Chain building against the sequential rule on small random captures."""

import random

import pytest

from usagelake.operators import chains

SCHEMA = (
    "id string, profile string, protocol string, started_us bigint, model string, start_shape boolean, "
    "response_id string, previous_response_id string, tool_offers array<string>, tool_asks array<string>, "
    "lineage array<string>"
)
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]


def leads(p, c):
    """Evidence by which call p leads to call c, strongest first, or None."""
    if p["protocol"] != c["protocol"] or p["profile"] != c["profile"]:
        return None
    if p["model"] and c["model"] and p["model"] != c["model"]:
        return None
    if p["response_id"] and p["response_id"] == c["previous_response_id"]:
        return "explicit_id"
    if set(p["tool_offers"] or []) & set(c["tool_asks"] or []):
        return "tool_lineage"
    have, need = set(c["lineage"] or []), set(p["lineage"] or [])
    if need and need < have:
        return "context_lineage"
    return None


def by_rule(calls):
    built, rest = [], []
    for call in sorted(calls, key=lambda c: (c["started_us"], c["id"])):
        found = [(chain, leads(chain[-1][0], call)) for chain in built if leads(chain[-1][0], call)]
        if len(found) == 1:
            found[0][0].append((call, found[0][1]))
        elif not found and call["start_shape"]:
            built.append([(call, "chain_start")])
        else:
            rest.append(call["id"])
    return built, rest


def random_calls(rng, n):
    calls = []
    for i in range(n):
        pick = rng.random
        calls.append({
            "id": f"gw-{i:014d}" if pick() < 0.9 else f"x{i}", "profile": rng.choice("ab"),
            "protocol": rng.choice(["anthropic_messages", "openai_responses"]),
            "started_us": rng.randrange(n), "model": rng.choice(["", "m", "m", "k"]), "start_shape": pick() < 0.5,
            "response_id": f"r{rng.randrange(n)}" if pick() < 0.6 else None,
            "previous_response_id": f"r{rng.randrange(n)}" if pick() < 0.6 else None,
            "tool_offers": [f"t{rng.randrange(n)}" for _ in range(rng.randrange(3))],
            "tool_asks": [f"t{rng.randrange(n)}" for _ in range(rng.randrange(3))],
            "lineage": rng.sample("abcdefgh", rng.randrange(5)) if pick() < 0.6 else None,
        })
    return calls


def check(spark, calls, **options):
    built, rest = by_rule(calls)
    frame = spark.createDataFrame([tuple(c[n] for n in NAMES) for c in calls], SCHEMA)
    got = chains.build_chains(frame, **options)
    want = {}
    for chain in built:
        root = chain[0][0]["id"]
        for place, (call, method) in enumerate(chain, start=1):
            want[call["id"]] = (root, place, method, chain[place - 2][0]["id"] if place > 1 else None)
    members = {r.id: r for r in got.members.collect()}
    links = {r.id: r for r in got.links.collect()}
    assert set(members) == set(want)
    for call, (root, place, method, previous) in want.items():
        assert (members[call].call, links[call].method, links[call].previous_id) == (place, method, previous)
        assert members[call].root_id == root and members[call].chain_id == members[root].chain_id
    assert sorted(r.id for r in got.uncorrelated.collect()) == sorted(rest)
    return got


@pytest.mark.parametrize("seed", [3, 4])
def test_random_captures(spark, seed):
    check(spark, random_calls(random.Random(seed), 60), block=5)


def test_large_contested_groups_take_steps_instead(spark):
    check(spark, random_calls(random.Random(5), 60), group_calls=0)


def _call(i, shape=True, previous=None, lineage=None, **more):
    return {"id": f"c{i:04d}", "profile": "p", "protocol": "openai_responses", "started_us": i, "model": "m", "start_shape": shape,
            "response_id": f"r{i}", "previous_response_id": previous, "tool_offers": [], "tool_asks": [], "lineage": lineage, **more}


def _frame(spark, calls):
    return spark.createDataFrame([tuple(c[n] for n in NAMES) for c in calls], SCHEMA)


def test_asks_follow_hashes(spark):
    """A growing conversation, and many contexts over few hashes, which mostly contain each other."""
    for n in (50, 100, 200):
        grown = [_call(i, lineage=[f"h{k}" for k in range(i + 1)]) for i in range(n)]
        rng = random.Random(n)
        few = [_call(1000 + i, lineage=rng.sample("abcdefghijkl", 6), profile="q") for i in range(n)]
        found = chains.lineage(_frame(spark, grown + few))
        hashes = sum(len(set(c["lineage"])) for c in grown + few)
        # Each under two model variants.
        assert found.asks.where("method = 2").count() == 2 * hashes
        assert found.offers.where("method = 2").count() == 4 * n


@pytest.mark.parametrize("letters, size", [("abcdefgh", 4), ("abcdefghijklmnopqrstuvwxyz", 9)])
def test_latest_context_over_few_hashes(spark, letters, size):
    rng = random.Random(size)
    calls = [_call(i, lineage=rng.sample(letters, rng.randrange(1, size + 1)), model=rng.choice(["", "m", "k"])) for i in range(150)]
    got = {r.id: r.previous_id for r in chains.latest_predecessor(_frame(spark, calls), "context_lineage", block=40).collect()}
    want = {}
    for i, c in enumerate(calls):
        for p in calls[:i]:
            if set(p["lineage"]) < set(c["lineage"]) and (not p["model"] or not c["model"] or p["model"] == c["model"]):
                want[c["id"]] = p["id"]
    assert got == want


def test_contested_links_do_not_add_steps(spark):
    """Each pair of calls asks for one predecessor, and each pair's fate hangs on the pair before."""
    calls = [_call(0)]
    for k in range(1, 25):
        calls += [_call(2 * k, k % 3 > 0, f"r{2 * k - 2}"), _call(2 * k + 1, k % 2 > 0, f"r{2 * k - 2}")]
    got = check(spark, calls)
    assert got.rounds <= 2


def test_repeated_starts_are_told_apart_by_set(spark):
    calls = [_call(i, lineage=["p", "u"]) for i in range(30)] + [_call(40, lineage=["p", "u", "v"]), _call(41, lineage=["q"]),
             _call(42, False, lineage=["q", "v"]), _call(43, False, lineage=["p", "u", "v", "w"])]
    check(spark, calls)


def test_long_path_without_a_start(spark):
    """A run whose first calls are not starts: the chain begins where one is."""
    calls = [{
        "id": f"c{i:03d}", "profile": "p", "protocol": "openai_responses", "started_us": i, "model": "",
        "start_shape": i in (9, 20), "response_id": f"r{i}", "previous_response_id": f"r{i - 1}", "tool_offers": [],
        "tool_asks": [], "lineage": None} for i in range(40)]
    got = check(spark, calls, block=4)
    assert got.members.count() == 31


def test_ambiguous_and_forked(spark):
    def call(i, shape, previous=None, lineage=None, offers=(), asks=()):
        return {"id": f"c{i}", "profile": "p", "protocol": "openai_responses", "started_us": i, "model": "m",
                "start_shape": shape, "response_id": f"r{i}", "previous_response_id": previous,
                "tool_offers": list(offers), "tool_asks": list(asks), "lineage": lineage}

    got = check(spark, [
        call(1, True, lineage=["a"]), call(2, True, lineage=["a"]), call(3, True, lineage=["a", "b"]),
        call(4, True, previous="r1"), call(5, True, previous="r1"), call(6, False, previous="r1"),
        call(7, False, lineage=["a", "b", "c"]), call(8, True, offers=["t"]), call(9, False, asks=["t"], previous="r8"),
    ])
    assert [(r.kind, r.value) for r in got.evidence.where("id = 'c9'").collect()] == [("explicit_id", "r8")]


def test_chain_ids(spark):
    ids = spark.createDataFrame([("gw-0123456789abcdef",), ("gw-",), ("short",), ("",)], "id string")
    from pyspark.sql import functions as F

    got = [r[0] for r in ids.select(chains.chain_id(F.col("id"))).collect()]
    assert got == ["gwc-456789abcdef", "gwc-unknown", "gwc-short", "gwc-unknown"]


def test_chain_metrics(spark):
    def rows(chain, values):
        return [(chain, "gwc-one-label", i + 1, v, "estimated" if v is not None else None, v, "estimated" if v is not None else None,
                 None, None, None, None, 1000 + i, "m", "p", "q") for i, v in enumerate(values)]

    schema = (
        "root_id string, chain_id string, call bigint, attributed bigint, attributed_kind string, tool_result bigint, "
        "tool_result_kind string, history bigint, history_kind string, tool_definition bigint, tool_definition_kind string, "
        "started_us bigint, model string, profile string, protocol string")
    calls = spark.createDataFrame(
        rows("a", [10, 7, 12, 12, 17]) + rows("b", [5, 4, 4]) + rows("c", [5, None, 9]) + rows("d", [3]), schema)
    got = {r.root_id: r for r in chains.chain_metrics(chains.context_deltas(calls, block=2)).collect()}
    a, b, c, d = (got[x] for x in "abcd")
    assert (a.initial_context, a.final_context, a.peak_context, a.total_context, a.context_growth) == (10, 17, 17, 58, 7)
    assert (a.largest_growth, a.largest_growth_call, a.tool_result_growth, a.history_growth) == (5, 3, 7, None)
    assert (b.largest_growth, b.largest_growth_call) == (0, 0)
    assert (c.peak_context, c.total_context, c.largest_growth, c.context_growth) == (None, None, None, 4)
    assert (d.largest_growth, d.largest_growth_call, d.context_growth) == (None, 0, 0)


def test_roots_of_one_tail_are_two_chains(spark):
    def call(head, profile, at, previous=None):
        return {"id": f"gw-{head}-12345678901{at}", "profile": profile, "protocol": "openai_responses", "started_us": at, "model": "m",
                "start_shape": True, "response_id": f"r{profile}{at}", "previous_response_id": previous,
                "tool_offers": [], "tool_asks": [], "lineage": None}

    calls = [call("A", "p", 2), call("B", "q", 2), call("A", "p", 3, "rp2"), call("B", "q", 3, "rq2")]
    got = check(spark, calls)
    members = got.members.collect()
    assert len({r.chain_id for r in members}) == 1
    assert sorted((r.root_id, r.call) for r in members) == [
        ("gw-A-123456789012", 1), ("gw-A-123456789012", 2), ("gw-B-123456789012", 1), ("gw-B-123456789012", 2)]


def test_calls_of_one_model_are_scanned_once_a_key(spark, monkeypatch):
    scanned, carry = [], chains.carry

    def counted(rows, *rest, **more):
        scanned.append(rows.count())
        return carry(rows, *rest, **more)

    monkeypatch.setattr(chains, "carry", counted)
    calls = [_call(i, previous=f"r{i - 1}") for i in range(30)]
    found = chains.build_chains(_frame(spark, calls), context=False)
    assert sorted((r.id, r.call) for r in found.members.collect()) == [(f"c{i:04d}", i + 1) for i in range(30)]
    # An offer and an ask a call for the guess, and the end of the offer besides for the step.
    assert scanned == [60, 89] and found.longest == 30


def test_steps_after_the_first_read_contested_groups_only(spark, monkeypatch):
    """Six quiet chains and a contested group: after the first step only the latter is read again."""
    calls = []
    for c in range(6):
        for j in range(5):
            calls.append(_call(len(calls), tool_offers=[f"q{c}-{j}"], tool_asks=[f"q{c}-{j - 1}"] if j else [], start_shape=j == 0))
    # Two calls offer one id, so the one that asks for it is torn; what follows it depends on that.
    first = len(calls)
    for offers, asks, start in ((["x"], [], True), (["x"], [], True), (["y"], ["x"], True), (["z"], ["y"], True)):
        calls.append(_call(len(calls), tool_offers=offers, tool_asks=asks, start_shape=start))
    seen, step = [], chains._step

    def counted(found, paths, block):
        seen.append(found.nodes.count())
        return step(found, paths, block)

    monkeypatch.setattr(chains, "_step", counted)
    got = chains.build_chains(_frame(spark, calls))
    assert seen[0] == len(calls) and len(seen) > 1 and max(seen[1:]) == len(calls) - first
    built, rest = by_rule(calls)
    want = sorted((chain[0][0]["id"], k + 1, call["id"]) for chain in built for k, (call, _) in enumerate(chain))
    assert sorted(map(tuple, got.members.select("root_id", "call", "id").collect())) == want
    assert sorted(r.id for r in got.uncorrelated.collect()) == sorted(rest)


def test_one_row_a_call_is_kept_however_many_keys_it_has(spark, monkeypatch):
    kept, cut = [], chains.cut

    def counted(rows):
        got = cut(rows)
        kept.append(got.count())
        return got

    monkeypatch.setattr(chains, "cut", counted)
    calls = [_call(i, tool_offers=[f"t{k}" for k in range(20 + i)], tool_asks=[f"t{k}" for k in range(19 + i)] if i else []) for i in range(6)]
    found = chains.build_chains(_frame(spark, calls))
    assert sorted((r.id, r.call) for r in found.members.collect()) == [(f"c{i:04d}", i + 1) for i in range(6)]
    assert max(kept) == len(calls)
    # The ids that lead to a call are read off both calls.
    assert found.evidence.where("id = 'c0001'").count() == 20 and {r.kind for r in found.evidence.collect()} == {"tool_lineage"}
