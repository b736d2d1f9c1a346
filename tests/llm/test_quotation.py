import re

from freshet.llm.quotation import link_conversations


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def pieces(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute(rows):
    parsed, wrote = [], {}
    for conv, turn, role, text in rows:
        runs = []
        for line in text.split("\n") if text is not None else []:
            marks = re.match("(?:[ \t]*>)*", line)[0]
            if not runs or runs[-1][0] != marks.count(">"):
                runs.append((marks.count(">"), []))
            runs[-1][1].append(normal(line[len(marks) :]).split())
        runs = [(level, [words for words in lines if words]) for level, lines in runs]
        parsed.append(runs)
        if conv is not None and turn is not None:
            own = wrote.setdefault(conv, {}).setdefault(turn, set())
            for level, lines in runs:
                if level == 0 and lines:
                    own |= pieces(sum(lines, [])) | {tuple(words) for words in lines if len(words) < 5}

    def origin(conv, turn, words):
        if conv is None or turn is None:
            return None
        firsts = [min((t for t, own in wrote.get(conv, {}).items() if piece in own), default=None) for piece in pieces(words)]
        if None in firsts or max(firsts) >= turn:
            return None
        return max(firsts) if pieces(words) <= wrote[conv][max(firsts)] else None

    parent, stats = {}, []
    for (conv, turn, *_), runs in zip(rows, parsed, strict=True):
        origins = []
        for level, lines in runs:
            whole = origin(conv, turn, sum(lines, [])) if level and lines else None
            origins += [(level, origin(conv, turn, words) if whole is None else whole) for words in lines if level]
        up = [o for level, o in origins if level == 1 and o is not None]
        if up:
            parent[conv, turn] = max(up + [parent.get((conv, turn), -(10**9))])
        stats.append((len(origins), sum(o is not None for _, o in origins), max([level for level, _ in origins], default=0)))
    out = []
    for (conv, turn, role, text), s in zip(rows, stats, strict=True):
        start, depth = turn, 0
        while (conv, start) in parent:
            start, depth = parent[conv, start], depth + 1
        own = None if text is None else "\n".join(x for x in text.split("\n") if not re.match("[ \t]*>", x)).strip("\n")
        out.append((conv, turn, role, start, depth, parent.get((conv, turn)), *s, own))
    return sorted(out, key=str)


ROWS = [
    (1, 0, "a", "How does it work?\nPlease explain."),
    (1, 1, "b", "> How does it work?\nLike this."),
    (1, 2, "c", "An aside."),
    (1, 3, "a", ">> How does it work?\n> Like this.\n\nI see, thanks."),
    (1, 4, "b", "> an ASIDE\n>\n\nAnswer to the aside\n> Please   explain!"),
    (1, 5, "c", "> never written\n> quoted from later\nown"),
    (1, 6, "c", "quoted from later"),
    (1, 7, "a", "  > > > How does it work?\n  >> Like this.\n > I see, thanks.\ndeep"),
    (1, 8, "a", "> me too\nme too"),
    (2, 0, "a", "How does it work?"),
    (2, 1, "b", None),
    (2, 2, "b", ""),
    (2, 3, None, "> How does it work?"),
    (2, 3, None, "> How does it work?"),
    (2, None, "x", "> How does it work?\nno turn"),
    (None, 0, "x", "> How does it work?\nnot linked"),
    (None, 1, "y", "How does it work?"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", "e") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, position string, _row string")


def test_equals_brute_force(spark):
    rows = ROWS + [(3, k, "r", (f"> line {k - 1}\n" if k else "") + f"line {k}") for k in range(40)]
    out = link_conversations(frame(spark, rows)).collect()
    got = [(r.conv_id, r.turn, r.role, r.thread_turn, r.depth, r.parent_turn, r.n_quoted, r.n_linked, r.max_level, r.text) for r in out]
    assert sorted(got, key=str) == brute(rows)
    assert max(r.depth for r in out) == 39


def test_threads_follow_one_another(spark):
    out = link_conversations(frame(spark, ROWS)).collect()
    for conv in (1, 2, None):
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1))
        keys = [(r.thread_turn is not None, r.thread_turn or 0, r.turn or 0) for r in own]
        assert keys == sorted(keys)
    assert [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)] == [0, 1, 3, 7, 2, 4, 5, 6, 8]


def test_a_large_conversation_is_spread(spark):
    rows = [(9, k, "u", f"> same\nsame\nline {k}") for k in range(3000)]
    out = link_conversations(frame(spark, rows))
    assert sorted(r.position for r in out.collect()) == list(range(1, 3001))


def test_empty(spark):
    assert link_conversations(frame(spark, [])).count() == 0


LONG = "The committee met on Tuesday to discuss the new proposal and agreed that it needs more work before the summer break."
WRAPPED = "> The committee met on Tuesday\n> to discuss the new proposal and agreed\n> that it needs more work before the summer break."
MAIL = [
    (5, 0, "a", LONG + "\nRegards"),
    (5, 1, "b", "We met before: the committee met on Tuesday to discuss other things. Short words.\nYes, fine."),
    (5, 2, "c", WRAPPED + "\nWrapped anew."),
    (5, 3, "d", "> discuss the new proposal and agreed that it\nA part of a line."),
    (5, 4, "e", ">> that it needs more work\n>> before the summer break\n> Wrapped ANEW!\nNested."),
    (5, 5, "f", "> agreed that it needs another year\nNever written so."),
    (5, 6, "g", "> yes\nToo short to be a part."),
    (5, 7, "h", "> Yes, fine.\nA whole line."),
    (5, 8, "i", "> A part of a line.\n> Nested.\nTwo origins under one another."),
    (5, 9, "j", "> the committee met on Tuesday to discuss other things\n>\n> Short words. Yes, fine.\nAcross lines, with a blank one."),
    (5, 10, "k", "> other things. Short words. Regards to all of you\nPut together from several."),
]


def test_passages_wrapped_anew_and_parts(spark):
    out = {r.turn: r for r in link_conversations(frame(spark, MAIL)).collect()}
    assert {t: r.parent_turn for t, r in out.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: 2, 5: None, 6: None, 7: 1, 8: 4, 9: 1, 10: None}
    assert (out[2].n_quoted, out[2].n_linked) == (3, 3) and (out[4].n_linked, out[4].max_level) == (3, 2)
    assert out[8].n_linked == 2 and out[9].n_linked == 2 and out[9].text == "Across lines, with a blank one."


def test_passages_equal_brute_force_and_sql(spark):
    import random

    import duckdb

    from freshet.llm.quotation import oracle_sql

    rng = random.Random(6)
    words = "alpha beta gamma delta one two three".split()
    rows = list(MAIL) + [r for r in ROWS if r[1] is not None]
    for conv in range(10, 16):
        written = []
        for turn in range(12):
            lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 3))]
            for _ in range(rng.randint(0, 2)):
                if written:
                    source = rng.choice(written).split()
                    begin = rng.randrange(len(source))
                    part = source[begin : begin + rng.randint(1, 14)]
                    cut = rng.randint(1, len(part))
                    lines += [f"{'>' * rng.randint(1, 2)} {' '.join(p)}" for p in (part[:cut], part[cut:]) if p]
            written += [line for line in lines if line[0] != ">"]
            rows.append((conv, turn, "u", "\n".join(lines)))
    got = link_conversations(frame(spark, rows)).toPandas()
    flat = [(r.conv_id, r.turn, r.role, r.thread_turn, r.depth, r.parent_turn, r.n_quoted, r.n_linked, r.max_level, r.text) for r in link_conversations(frame(spark, rows)).collect()]
    assert sorted(flat, key=str) == brute(rows) and sum(r[7] for r in flat) > 20
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    sql = con.execute(oracle_sql())
    names = [d[0] for d in sql.description]
    assert sorted(got.columns) == sorted(names)
    tidy = lambda v: None if v is None or v != v else int(v) if isinstance(v, float) else v
    want = sorted((tuple(tidy(row[names.index(c)]) for c in sorted(names)) for row in sql.fetchall()), key=str)
    have = sorted((tuple(tidy(v) for v in row) for row in got[sorted(names)].astype(object).itertuples(index=False, name=None)), key=str)
    assert have == want
