"""Line dedup, quality rules, mixing and url filters: SQL twins on whole tables, brute force and odd rows."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from odd import ODD_ROWS, bag
from parapet.llm import line_dedup, mixing, quality, url_filters
from parapet.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F


def twin(folder, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cursor = db.execute(SQL[name])
    return [d[0] for d in cursor.description], cursor.fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_twins(spark, data, name):
    df = QUERIES[name](spark, data)
    columns, rows = twin(data, name)
    assert sorted(df.columns) == sorted(columns)
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(rows) and rows


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op3_line_dedup", "op4_quality_rules"])
def test_native(spark, data, name):
    assert not re.search("Python|Pandas|Arrow", _plan(QUERIES[name](spark, data)))


# Lines

def test_lines_of_hosts(documents):
    rows = [(i, f"own line {i}\n menu \nfoot", None, "a") for i in range(10)]
    rows += [(20 + i, "menu\nother", None, "b") for i in range(4)] + [(30, "menu\n\nmenu", None, "c")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(rows, clashes=True), min_pages=3).collect()}
    assert all(out[i].text == f"own line {i}" and (out[i].n_lines, out[i].n_dropped) == (3, 2) for i in range(10))
    # Four copies of one page are one page; a page of a small host keeps its lines.
    assert all(out[20 + i].text == "menu\nother" for i in range(4)) and out[30].text == "menu\n\nmenu"
    emptied = line_dedup.dedup_lines(documents([(i, "x\n" * (i + 1), None, None) for i in range(6)]), min_pages=2).collect()
    assert all(r.text == "" and r.source is None for r in emptied)


def test_lines_of_odd_rows(documents):
    df = documents(ODD_ROWS, clashes=True)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter((i, t) for i, t, *_ in ODD_ROWS)
    assert line_dedup.dedup_lines(documents([])).collect() == []


# Quality

def brute_quality(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(documents):
    texts = [t for _, t, *_ in ODD_ROWS] + ["a b c a b c a b", "a a a a", "a b c", "x y z w x y z", "#1 <b> & | $\n\n#1 <b> & | $", "é|ü ß\x0bq\x0cr", "\x1fa \x85b"]
    texts += [" ".join(["one two three four five"] * 9), " ".join(f"w{i}" for i in range(60)) + "."]
    rows = [(i, t) for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in quality.measure(documents(rows, clashes=True)).collect()}
    for i, t in rows:
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(t), t[:50]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert out[len(rows) - 1].kept and not out[0].kept
    assert quality.measure(documents([])).collect() == []


@pytest.mark.parametrize(("line", "good"), [
    ("A plain sentence.", True), ("It ends so: \"yes!\"", True), ("No stop here", False), ("Home | News | Sport | More.", False),
    ("Licensed under the MIT License.", False), ("All rights reserved.", False), ("One | bar in a longer sentence is fine.", True),
])
def test_line_rules(spark, line, good):
    assert spark.createDataFrame([(line,)], "line string").select(quality.line_passes(F.col("line"))).first()[0] is good


@pytest.mark.parametrize("line", [
    "यह एक वाक्य है।", "这是一个句子。", "他说：“你好！”", "「こんにちは。」", "یہ ایک جملہ ہے۔", "هل هذا سؤال؟", "Սա նախադասություն է։", "ይህ ዓረፍተ ነገር ነው።", "ประโยคหนึ่ง", "Ένα ερώτημα;",
])
def test_lines_of_other_scripts(spark, line):
    assert spark.createDataFrame([(line,), (line + " x",)], "line string").select(quality.line_passes(F.col("line"))).collect()[0][0] is True


def test_documents_of_other_scripts_are_kept(documents):
    kinds = {1: ("शब्द", "।"), 2: ("句子", "。"), 3: ("جملہ", "۔"), 4: ("word", "")}
    rows = [(i, "\n".join(" ".join(f"{word}{k}x{j}" for j in range(6)) + mark for k in range(20))) for i, (word, mark) in kinds.items()]
    out = {r.doc_id: r for r in quality.measure(documents(rows)).collect()}
    assert [out[i].kept for i in kinds] == [True, True, True, False] and out[1].lost_chars == 0 and out[1].cleaned == rows[0][1]


def test_cleaned_text_and_notices(documents):
    text = "\n".join(["A first sentence stands here.", "Home | News | Sport | More.", " ", "Todos los derechos reservados.", "  And a last one.  "])
    (plain,) = quality.measure(documents([(1, text)])).collect()
    assert plain.cleaned == "A first sentence stands here.\nTodos los derechos reservados.\n  And a last one.  "
    (other,) = quality.measure(documents([(1, text)], clashes=True), notices="derechos reservados").collect()
    assert other.cleaned == "A first sentence stands here.\n  And a last one.  " and other.lost_chars == plain.lost_chars + 30
    assert [r.cleaned for r in quality.measure(documents([(1, None), (2, "")])).collect()] == ["", ""]


# Mixing

def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("x", "a", 10), ("x", "b", 1000), ("y", "c", 1000), ("z", "d", 5)], "l0 string, l1 string, tokens long")
    out = {r.l1: r.budget for r in mixing.budgets(leaves, ["l0", "l1"], {"z": 0.0}, 600 / 2015, 1).collect()}
    assert out == {"a": 10, "b": 290, "c": 300, "d": 0}
    out = {r.l1: r.budget for r in mixing.budgets(leaves, ["l0", "l1"], {"x": 3.0}, 1600 / 2015, 1).collect()}
    assert out == {"a": 10, "b": 1000, "c": 585, "d": 5}


def test_prefix_of_each_leaf(documents, monkeypatch):
    """Budgets are met by whole documents in the seeded order; every leaf takes a run from its start."""
    monkeypatch.setattr(mixing, "ROWS_PER_PREFIX", 3)
    rows = [(i, " ".join(["w"] * (i % 13)), "en", "a" if i % 3 else "b") for i in range(300)] + [(500 + i, "w w w", "en", None) for i in range(9)]
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    df = documents(rows, clashes=True)
    out = mixing.mix(df, levels, {}, 0.5, max_epochs=3)
    assert out.columns == [*df.columns, "n_tokens", "n_copies"]
    got = {r.doc_id: r.n_copies for r in out.collect()}
    import hashlib
    leaves = defaultdict(list)
    for i, t, _, s in rows:
        leaves[s].append((i, len(t.split()), t))
    tokens = {s: sum(n for _, n, _ in x) for s, x in leaves.items()}
    budget = int(sum(tokens.values()) * 0.5)
    small = 3 * tokens[None]
    assert small < budget / 3  # the small leaf is filled up, the others share what is left
    for s, x in leaves.items():
        given = small if s is None else int((budget - small) / 2)
        given = min(given, 3 * tokens[s])
        epochs, rest = divmod(given, tokens[s])
        key = lambda r: hashlib.md5(f"337:{epochs}:{r[0]}:{hashlib.md5(r[2].encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        total = 0
        for r in sorted(x, key=key):
            total += r[1]
            assert got.get(r[0], 0) == epochs + (rest > 0 and total <= rest), (s, r)


def test_no_budget_is_lost(documents):
    """What the document at the end can't give whole, its first words give."""
    rows = [(i, "w " * 10, None, "many") for i in range(10)] + [(99, " ".join(f"x{i}" for i in range(100)), None, "one")]
    df = documents(rows, clashes=True)
    out = mixing.mix(df, {"source": F.col("source")}, {}, 0.6, max_epochs=1, cut=True)
    assert out.columns == [*df.columns, "n_tokens", "n_copies", "n_part"]
    got = out.collect()
    assert sum(r.n_tokens * r.n_copies + r.n_part for r in got) == 120
    (one,) = [r for r in got if r.source == "one"]
    assert (one.n_copies, one.n_part) == (0, 60)
    assert out.where("source = 'one'").select(mixing.first_words(F.col("text"), F.col("n_part"))).first()[0] == " ".join(f"x{i}" for i in range(60))
    # Copies of one row share the rest.
    alike = [(7, "a b c d", None, "s")] * 5
    got = mixing.mix(documents(alike), {"source": F.col("source")}, {}, 0.55, max_epochs=1, cut=True).collect()
    assert [(r.n_copies, r.n_part) for r in got] == [(0, 2)] * 5


def test_first_words_keep_white_space(spark):
    text = " a\tb \n c\x1fd  e"
    df = spark.createDataFrame([(text, n) for n in range(0, 7)], "t string, n long")
    want = ["", " a", " a\tb", " a\tb \n c\x1fd", text, text, text]
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n").cast("int"))).collect()] == want


def test_mixing_odd_rows(documents):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(documents(ODD_ROWS, clashes=True), levels, {}, 1.0, max_epochs=1).collect()
    assert sum(r.n_tokens * r.n_copies for r in out) == sum(len((t or "").split()) for _, t, *_ in ODD_ROWS)
    assert mixing.mix(documents([]), levels, {}, 1.0).collect() == []


# Urls

def brute_judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0, 0, False, ""), (len(rule), len(h), verdict == "block", rule))
    return host, path, best and best[3], ("block" if best[2] else "allow") if best else "allow"


def test_urls(spark):
    rules = [*url_filters.RULES, ("net", "block"), ("a.net/e", "allow"), ("b.org/x/", "allow"), ("b.org/x/", "block")]
    urls = [
        None, "", "example.com/en/", "://", "http://", "http://EXAMPLE.com", "http://example.com/en", "http://example.com/en/x?y#z", "https://www.Example.com/en/",
        "http://x.example.com/en//", "http://com/", "http://a.net/es/1", "http://a.net/english", "http://net/fr/", "http://.net/es/", "http://net./es/",
        "http://example.com:80/en/", "http://b.org/x/y", "http://ÉXAMPLE.com/É", "http://" + "a." * 50_000 + "com/" + "p/" * 50_000, "x://y://example.com/",
        "http://example.com?/en/", "http://example.com#/", "http://a\nb.com/c\nd",
    ]
    pages = spark.createDataFrame([(i, u, "x", "x") for i, u in enumerate([*urls, urls[7]])], "page_id long, url string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, url_filters.rule_table(spark, rules)).collect()}
    assert got == {i: brute_judge(u, rules) for i, u in enumerate([*urls, urls[7]])}
    none = url_filters.judge(pages, url_filters.rule_table(spark).limit(0), default="block")
    assert none.columns == ["page_id", "host", "path", "rule", "verdict"] and {r.verdict for r in none.collect()} == {"block"}
    assert url_filters.judge(pages.limit(0), url_filters.rule_table(spark)).collect() == []
    assert bag(url_filters.judge(pages.where("page_id = 7").union(pages.where("page_id = 7")), url_filters.rule_table(spark))) == 2 * [
        (7, "example.com", "/en/x", "example.com/en/", "block")]
