"""Session versions against a plain replay of the batches."""

import random

import pytest

from lodestone.llm import sessions
from lodestone.llm.queries import op11_session_merging


def replay(events, gap):
    """Versions by going through the batches of each user and building all sessions anew each time."""
    out = {}
    for user in {e[0] for e in events}:
        own = [e for e in events if e[0] == user]
        standing = []
        for batch in sorted({e[2] for e in own}):
            times = sorted(e for e in own if e[2] <= batch)
            times.sort(key=lambda e: e[1])
            groups = []
            for e in times:
                if groups and e[1] - groups[-1][-1][1] <= gap:
                    groups[-1].append(e)
                else:
                    groups.append([e])
            for g in groups:
                new = sum(e[2] == batch for e in g)
                if not new:
                    continue
                start, end = g[0][1], g[-1][1]
                inside = [s for s in standing if start <= s[1] and s[2] <= end]
                for s in inside:
                    standing.remove(s)
                    out[s[3]][-2:] = [batch, start]
                key = (user, batch, start)
                out[key] = [*key, end, len(g), new, len(inside), sum(e[3] or 0 for e in g), None, None]
                standing.append((user, start, end, key))
    return sorted(map(tuple, out.values()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sessions.COLUMNS).collect()), key=str)


def random_events(rng, users, n, span, batches):
    return [(rng.randrange(users), rng.randrange(-span // 4, span), rng.randrange(-3, batches), rng.choice((None, rng.randrange(1 << 32)))) for _ in range(n)]


@pytest.mark.parametrize(("seed", "fan_out", "batches", "span", "gap"), [(1, 2, 9, 3000, 40), (2, 3, 40, 900, 10), (3, 16, 5, 20000, 240), (4, 4, 70, 400, 3)])
def test_versions_equal_the_replay(spark, seed, fan_out, batches, span, gap):
    rng = random.Random(seed)
    events = random_events(rng, 6, 260, span, batches)
    events += events[:20]  # repeated rows count each
    schema = "user long, second long, batch long, h long, part string"
    df = spark.createDataFrame([(*e, "x") for e in events], schema)
    nulls = spark.createDataFrame([(None, 1, 1, 1, "x"), (1, None, 1, 1, "x"), (1, 1, None, 1, "x")], schema)
    got = sessions.session_versions(df.union(nulls).repartition(7), gap=gap, fan_out=fan_out)
    assert rows_of(got) == replay(events, gap)


def test_one_user_holds_nearly_all(spark):
    """A dense user, whose one session every batch extends, beside a few others."""
    rng = random.Random(5)
    events = [(1, t, t // 200 + rng.choice((0, 0, 0, 2)), t) for t in range(0, 6000, 3)] + random_events(rng, 9, 40, 6000, 30)
    df = spark.createDataFrame(events, "user long, second long, batch long, h long").repartition(11)
    assert rows_of(sessions.session_versions(df, gap=5, fan_out=4)) == replay(events, 5)


def test_components_of_chains_cut_between_batches(spark):
    """Links dealt at random: the local stars settle little, the alternating steps do the rest."""
    links = [(u, 0, k, k + 1) for u in range(3) for k in range(60) if k % 20 != 19]
    random.Random(6).shuffle(links)
    from lodestone.runtime import Scratch

    df = spark.createDataFrame(links, "user long, part long, a long, b long").repartition(40)
    got = {(r.user, r.node): r.label for r in sessions.star_components(df, Scratch(spark, "stars"), "stars").collect()}
    assert got == {(u, k): k // 20 * 20 for u in range(3) for k in range(60) if k % 20}


def test_no_events(spark):
    empty = spark.createDataFrame([], "user long, second long, batch long, h long")
    assert sessions.session_versions(empty).collect() == []
    lone = spark.createDataFrame([(7, 5, 2, 9)], "user long, second long, batch long, h long")
    assert rows_of(sessions.session_versions(lone)) == [(7, 2, 5, 5, 1, 1, 0, 9, None, None)]


def test_query_skips_rows_without_turn_or_conversation(spark, tmp_path):
    rows = [(k // 6, k % 6, "user", "t") for k in range(120)] + [(3, None, "user", "t"), (None, 2, "user", None), (3, 1, "user", "t")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = op11_session_merging(spark, str(tmp_path))
    assert got.columns == sessions.COLUMNS
    assert got.agg({"n_new": "sum"}).first()[0] == 121
