import random
import re

import duckdb
import pandas as pd
from data import words

from lexiprint.llm import common, quotes

SCHEMA = "conv_id long, turn long, role string, text string, thread string, message string, key string"


def norm(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip()


def parse(text):
    out = []
    for line in re.split("\r?\n", text or ""):
        m = re.match(r"[ \t]*(?:>[ \t]?)+", line)
        out.append((m[0].count(">") if m else 0, line[m.end() :] if m else line))
    runs = []
    for i, (level, body) in enumerate(out):
        if not body.strip(" "):
            continue
        if i and runs and runs[-1][0] == level and out[i - 1][0] == level and out[i - 1][1].strip(" "):
            runs[-1][1].append(body)
        else:
            runs.append((level, [body]))
    return out, runs


def long_lines(lines):
    return [norm(x) for x in lines if len(re.split(r"\s+", x.strip(" "))) >= quotes.LINE_WORDS]


def plain(rows):
    rows = list(dict.fromkeys(rows))
    own, asks = {}, {}
    for k, (c, t, _, text) in enumerate(rows):
        lines, runs = parse(text)
        mine = [r for r in runs if r[0] == 0]
        flat = [x for r in mine for x in r[1]]
        own[k] = {norm(" ".join(flat)), *(norm(" ".join(r[1])) for r in mine), *long_lines(flat)} if mine else set()
        q = [r for r in runs if r[0] > 0]
        asks[k] = {(r[0], norm(" ".join(r[1]))) for r in q} | {(r[0], x) for r in q for x in long_lines(r[1])}
        asks[k] |= {(d, norm(" ".join(x for r in q if r[0] == d for x in r[1]))) for d in {r[0] for r in q}}
    first = {}
    for k, (c, t, *_) in enumerate(rows):
        if c is not None and t is not None:
            for h in own[k]:
                first[c, h] = min(first.get((c, h), t), t)
    parent, out = {}, {}
    for k, (c, t, role, text) in enumerate(rows):
        links = [(d, -first[c, h], h) for d, h in asks[k] if c is not None and t is not None and first.get((c, h), t) < t]
        reply = -min(links)[1] if links else None
        out[k] = [c, t, role, reply, len({h for _, h in asks[k]}) if c is not None and t is not None else 0, len({h for *_, h in links})]
        if reply is not None:
            parent[c, t] = max(parent.get((c, t), reply), reply)
    for k, o in out.items():
        c, t = o[:2]
        thread, depth = t, 0
        if o[3] is not None:
            while (c, thread) in parent:
                thread, depth = parent[c, thread], depth + 1
        o += [thread, depth]
    return out


def conversation(seed, c, n):
    r = random.Random(seed)
    said, rows = [], []
    for t in range(n):
        body = "\n".join(words(r.randint(2, 9), seed * 1000 + t * 10 + j) for j in range(r.randint(1, 3)))
        text = body
        if said and r.random() < 0.8:
            target = r.choice(said)
            lines = target.split("\n")
            part = r.choice([target, r.choice(lines), target.upper()])
            quoted = "\n".join("> " + x for x in part.split("\n"))
            text = r.choice([f"On Monday someone wrote:\n{quoted}\n\n{body}", f"{body}\n{quoted}", f">> deep line of words here\n{quoted}\n{body}"])
        said.append(text if r.random() < 0.5 else body)
        rows.append((c, t, "user", text))
    return rows


def test_matches_brute_force(spark):
    rows = [x for k in range(8) for x in conversation(k, k, 25)] + conversation(99, 50, 120)
    rows += [(1, 3, "user", rows[3][3])] * 5 + [(None, 2, "user", "> x y z w"), (7, None, "a", "hello"), (60, 0, None, None), (60, 1, "user", ""), (60, 2, "user", "> \n>\n>> "), (61, 1, "u", "> " + words(20_000, 4)), (61, 0, "u", words(20_000, 4))]
    df = spark.createDataFrame([(*r, "t", "m", "k") for r in rows], SCHEMA)
    got = quotes.link_quotes(df).collect()
    want = plain(rows)
    assert sorted((tuple(r[c] for c in ("conv_id", "turn", "role", "reply_to", "quoted", "linked", "thread", "depth")) for r in got), key=repr) == sorted(map(tuple, want.values()), key=repr)
    assert sum(r["reply_to"] is not None for r in got) > 150 and max(r["depth"] for r in got) > 5
    by = {}
    for r in got:
        by.setdefault(r["conv_id"], []).append(r)
    for rs in by.values():
        assert sorted(r["position"] for r in rs) == list(range(len(rs)))
        rs.sort(key=lambda r: r["position"])
        keys = [(r["thread"] if r["thread"] is not None else -1, r["turn"] if r["turn"] is not None else -1) for r in rs]
        assert keys == sorted(keys)
    assert not any(">" in r["text"] or "wrote:" in r["text"] for r in got)
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    columns = ["conv_id", "turn", "role", "reply_to", "thread", "depth", "levels", "quoted", "linked", "text"]
    told = con.sql(f"select {', '.join(columns)} from ({quotes.SQL_AS_WRITTEN})").limit(100_000).fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(map(tuple, told), key=repr)


def test_nested_levels_and_text(spark):
    rows = [(1, 0, "a", "First thing said here.\nSecond line of it."), (1, 1, "b", "On Tue A wrote:\n> First thing said here.\n> Second line of it.\n\nI do agree with this."), (1, 2, "a", "B wrote:\n> A wrote:\n>> first THING said here.\n> I do agree with this!\nFine then, thanks all.")]
    got = {r["turn"]: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[t]["reply_to"] for t in range(3)] == [None, 0, 1] and [got[t]["depth"] for t in range(3)] == [0, 1, 2]
    assert [got[t]["levels"] for t in range(3)] == [0, 1, 2] and {got[t]["thread"] for t in range(3)} == {0}
    assert got[1]["text"] == "I do agree with this." and got[2]["text"] == "Fine then, thanks all."


def test_empty(spark):
    assert quotes.link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_threads_of_a_hub(spark, monkeypatch):
    """Many turns answer one message, with joins that deal heavy messages apart."""
    monkeypatch.setattr(common, "LIGHT", 20)
    first = words(12, 1)
    rows = [(1, 0, "user", first, "t", "m", "k")] + [(1, i, "user", f"> {first}\n\n{words(9, i)}", "t", "m", "k") for i in range(1, 150)]
    got = quotes.link_quotes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["thread"] == 0 and r["depth"] == int(r["turn"] > 0) and r["reply_to"] == (0 if r["turn"] else None) for r in got) and len(got) == 150


def test_mail_links_in_each_style(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"{words(8, 100 * c + t)}\n{words(9, 500 * c + t)}", "t", "m", "k") for c in range(7) for t in range(6)]
    rows += [(None, 1, None, None, "t", "m", "k"), (1, None, None, None, "t", "m", "k")]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_replies(spark.createDataFrame(rows, SCHEMA)).collect()}
    texts = {(r[0], r[1]): r[3] or "" for r in rows}
    for (c, t), r in got.items():
        if c is None or t is None:
            continue
        style = (c + t) % 7
        want = None if t == 0 or style == 0 else t - 2 if style == 6 and t > 1 else t - 1 if style != 6 else None
        assert r["reply_to"] == want and r["text"] == texts[c, t], (c, t)
        assert r["levels"] == (0 if want is None else 2 if style == 2 and t > 1 else 1)
