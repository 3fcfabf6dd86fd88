"""Role repair against an exhaustive search, and rendering."""

import itertools
import random

import pytest

from understory.llm.chat import ALIASES, ASSISTANT, BEGIN, NEXT, ROLES, Costs, format_chats, role_number

SCHEMA = "conv_id bigint, turn bigint, role string, text string, seq int, action string"


def legal(roles):
    state = BEGIN
    for r in roles:
        if r not in NEXT[state]:
            return False
        state = r
    return state == ASSISTANT or not roles


def cheapest(roles, costs, limit=3):
    """Least (cost, insertions) over all labels, merges and insertions of up to `limit` turns in each gap."""
    best = None
    fills = [x for n in range(limit + 1) for x in itertools.product(range(1, 5), repeat=n)]
    memo = {}

    def go(k, state):
        if (k, state) in memo:
            return memo[k, state]
        options = []
        for fill in fills:
            s, ok = state, True
            for f in fill:
                ok &= f in NEXT[s]
                s = f
            if not ok:
                continue
            price = costs.insert * len(fill)
            if k == len(roles):
                if s == ASSISTANT or (not roles):
                    options.append((price, len(fill)))
                continue
            for q in range(1, 5):
                label = 0 if q == roles[k] else costs.unknown if roles[k] == 0 else costs.relabel
                if q in NEXT[s]:
                    a, b = go(k + 1, q)
                    options.append((a + price + label, b + len(fill)))
                if q == s and not fill:
                    a, b = go(k + 1, q)
                    options.append((a + label + costs.merge, b))
        memo[k, state] = min(options)
        return memo[k, state]

    return go(0, BEGIN)


def check(rows, given, costs):
    """Rows of one conversation, by seq, against its given turns."""
    assert [r.seq for r in rows] == list(range(len(rows)))
    body, last = rows[:-1], rows[-1]
    assert last.action == "close" and last.turn is None
    path, price, inserted, taken = [], 0, 0, []
    for r in body:
        q = ROLES.index(r.role)
        if r.action == "insert":
            price, inserted = price + costs.insert, inserted + 1
            path.append(q)
            assert r.text == ""
            continue
        role = role_number(given[len(taken)][1])
        taken.append(r.text)
        if role != q:
            price += costs.unknown if role == 0 else costs.relabel
            assert "relabel" in r.action
        if "merge" in r.action:
            assert path[-1] == q
            price += costs.merge
        else:
            path.append(q)
    assert taken == [g[2] or "" for g in given]
    assert legal(path)
    assert (price, inserted) == cheapest([role_number(g[1]) for g in given], costs)
    whole = "".join(r.rendered for r in rows)
    assert whole.count("<|end|>") == len(path) and whole.startswith(f"<|{ROLES[path[0]]}|>\n")


@pytest.mark.parametrize("chunk_turns", [2, 4096])
def test_repairs_are_cheapest(spark, chunk_turns):
    rng = random.Random(chunk_turns)
    names = ["system", "user", "assistant", "tool", "Human", " GPT ", "odd", None]
    rows = [(c, t, rng.choice(names), rng.choice(["hi", "", None, "x\ny"])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(90, t, "user", "again") for t in range(300)] + [(91, None, "user", "a"), (91, None, "assistant", "b"), (91, 0, "user", "c")]
    rows += [(92, 5, "user", "same")] * 4 + [(None, 1, "assistant", "no id")]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], SCHEMA).repartition(4, "turn")
    costs = Costs()
    got = {}
    for r in format_chats(df, costs, chunk_turns=chunk_turns).collect():
        got.setdefault(r.conv_id, []).append(r)
    given = {}
    for r in rows:
        given.setdefault(r[0], []).append(r[1:])
    assert set(got) == set(given)
    for c, out in got.items():
        out.sort(key=lambda r: r.seq)
        order = sorted(given[c], key=lambda g: -1 if g[0] is None else g[0])
        if c == 91:  # equal turns: the table's order
            kept = [r.text for r in out if r.action not in ("insert", "close")]
            order = sorted(order[:2], key=lambda g: kept.index(g[2])) + order[2:]
        check(out, order, costs)


def test_other_costs(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a", 1, ""), (1, 1, "assistant", "b", 1, "")], SCHEMA)
    dear = Costs(merge=9, relabel=1, insert=9)
    roles = [r.role for r in format_chats(df, dear).orderBy("seq").collect() if r.action != "close"]
    assert roles == ["user", "assistant"]


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000, 1, ""), (1, 1, "assistant", "y", 1, "")], SCHEMA)
    out = format_chats(df).orderBy("seq").collect()
    assert [r.action for r in out] == ["keep", "keep", "close"] and len(out[0].text) == 3_000_000
    assert format_chats(df.limit(0)).count() == 0


def test_aliases_name_roles():
    assert set(ALIASES.values()) <= set(ROLES)
