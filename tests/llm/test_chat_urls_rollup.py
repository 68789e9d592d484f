import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kairoscope.llm import chat, token_rollup, url_filter

TEXTS = ["", "hi", "</s>[INST] ok [/INST]", "<\\/s> [\\\\INST] <", "a <s>[INST]assistant[/INST]x</s>", "é\n🙂", "<|endoftext|>", "[", "<"]


def test_escape_is_reversible():
    rng = random.Random(1)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "x", "]", ">"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text
        assert not re.search(r"<s>|</s>|\[INST\]|\[/INST\]", chat.escape(text))


def test_conversations_read_back(spark, vocabulary):
    rng = random.Random(2)
    rows, want = [], defaultdict(list)
    for conv in [*range(40), None]:
        shared = conv is not None and conv % 3 == 0
        for turn in range(rng.randint(1, 5)):
            role = "system" if turn == 0 and shared else ("user", "assistant", None)[turn % 3]
            text = "same start" if turn == 0 and shared else rng.choice([*TEXTS, None])
            rows.append((conv, turn, role, text, 1))
            want[conv].append((role or "", text or ""))
    rows.append((77, 0, "assistant", "long " * 20_000, 1))
    want[77].append(("assistant", "long " * 20_000))
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node int")
    tree = chat.build(table, vocabulary)
    back = {r.conv_id: r for r in chat.read_back(tree, vocabulary).collect()}
    assert set(back) == set(want)
    for conv, turns in want.items():
        assert [(t.role, t.text) for t in back[conv].turns] == turns
        assert back[conv].loss_text == "".join(t for r, t in turns if r == "assistant")
    shards = defaultdict(list)
    for n in tree.nodes.collect():
        shards[n.shard].append(n)
    assert len(shards) > 1
    for nodes in shards.values():
        nodes.sort(key=lambda n: n.start)
        assert [n.end for n in nodes[:-1]] == [n.start for n in nodes[1:]] and nodes[0].start == 0
        by_id = {bytes(n.node): n for n in nodes}
        assert len(by_id) == len(nodes)  # emitted once
        spans = {}
        for n in nodes:
            chain, at = [], n
            while at is not None:
                chain.append((at.start, at.end))
                at = by_id[bytes(at.parent)] if at.parent is not None else None
            seen = {p for a, b in n.attends for p in range(a, b)}
            assert seen == {p for a, b in chain for p in range(a, b)}
            assert all(x.end < y.start for x, y in zip(n.attends, n.attends[1:], strict=False))
            assert n.position == sum(b - a for a, b in chain[1:]) and len(n.ids) == 4 * (n.end - n.start)
            for a, _ in chain:
                spans.setdefault(a, []).append((n.start, n.end))
        for a, inside in spans.items():  # depth first: a subtree is one interval
            assert max(e for _, e in inside) - a == sum(e - s for s, e in inside)


def test_long_conversation_stays_linear(spark, vocabulary):
    table = spark.range(2000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("x").alias("text"))
    nodes = chat.build(table, vocabulary).nodes
    assert nodes.agg(F.max(F.size("attends")), F.count("*")).first()[:] == (1, 2000)


def test_empty_conversations(spark, vocabulary):
    tree = chat.build(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), vocabulary)
    assert tree.nodes.collect() == [] and chat.read_back(tree, vocabulary).collect() == []


URLS = [
    "https://WWW.Example.org/es/1?x#y", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "https://org/a",
    "https://a.com/fr/x", "https://a.com/FR/x", "https://a.com/de/", "https://a.com?/de/", "ftp://a.net/de/://x", "no scheme", None, "", "://",
    "https://a.org", "https://É.ORG/ü", "https://a.net/" + "long/" * 3000, "https://x.net#frag/://", "http://a\n.net/b\nc?d",
]


def python_parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def python_rule(host, path):
    best = None
    for verdict, rule in url_filter.RULES:
        name, slash, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + rest):
            best = max(best or (0,), (len(rule), rule, verdict))
    return best


def python_scores(rows):
    """The model by dictionaries: Witten-Bell mixtures of character classes."""

    def codes(url):
        text = re.sub(r"^.*?://", "", url or "", flags=re.S).lower()
        return [0, 0, 0] + [url_filter.LETTERS.find("0" if c in "123456789" else c) + 1 or 31 for c in text] + [0]

    counts = {v: Counter() for v in ("allow", "block")}
    for url in rows:
        rule = python_rule(*python_parse(url))
        if rule:
            c = codes(url)
            counts[rule[2]].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    models = {}
    for verdict, grams in counts.items():
        levels = []
        for order in range(4):
            n, follow = Counter(), defaultdict(Counter)
            for gram, k in grams.items():
                n[gram[3 - order :]] += k
                follow[gram[3 - order : 3]][gram[3]] += k
            levels.append((n, follow))
        models[verdict] = levels

    def chance(verdict, gram):
        p = 1 / 32
        for order, (n, follow) in enumerate(models[verdict]):
            after = follow.get(gram[3 - order : 3])
            if after:
                p = (n[gram[3 - order :]] + len(after) * p) / (sum(after.values()) + len(after))
        return p

    out = []
    for url in rows:
        c = codes(url)
        grams = [tuple(c[i : i + 4]) for i in range(len(c) - 3)]
        out.append(sum(math.log(chance("allow", g)) - math.log(chance("block", g)) for g in grams) / len(grams))
    return out


def test_urls_equal_brute_force(spark):
    rng = random.Random(5)
    urls = URLS + [f"https://{rng.choice('abc')}{rng.choice('xy')}.{rng.choice(['com', 'net', 'example.org'])}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.randint(1, 99)}" for _ in range(80)]
    urls += urls[:5]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("verdict", F.lit(3))
    got = {r.page_id: r for r in url_filter.judge(table.repartition(3)).collect()}
    assert len(got) == len(urls)
    scores = python_scores(urls)
    for n, url in enumerate(urls):
        host, path = python_parse(url)
        rule = python_rule(host, path)
        assert (got[n].host, got[n].path) == (host, path)
        assert got[n].rule == (rule[1] if rule else None)
        assert got[n].score == pytest.approx(scores[n], abs=1e-5)
        if rule:
            assert got[n].verdict == rule[2]
    free = [(got[n].score, got[n].verdict) for n, url in enumerate(urls) if got[n].rule is None]
    assert max(s for s, v in free if v == "block") < min(s for s, v in free if v == "allow")  # one threshold


def test_urls_without_training(spark):
    table = spark.createDataFrame([(1, "https://a.net/x"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(table).collect()] == ["allow", "allow"]
    assert url_filter.judge(table.limit(0)).collect() == []


def test_rollup_follows_every_change(spark, tmp_path):
    rng = random.Random(7)
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "rollup"))
    schema = "action string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    state = {}
    for batch in range(5):
        rows = {}
        for _ in range(40):
            key = rng.choice([*range(25), None]), rng.choice(["a", "b"])
            rows[key] = (rng.choice(["insert", "revise", "delete"]), key[0], rng.choice(["s", None]), rng.choice(["en", "fr"]), key[1], rng.choice([0, 5, 9, None]))
        for key, row in rows.items():
            if row[0] == "delete":
                state.pop(key, None)
            else:
                state[key] = (row[2], row[3], row[4], row[5] or 0)
        changes = spark.createDataFrame([*rows.values(), *rows.values()], schema)  # repeated rows
        assert rollup.apply(changes, f"b{batch}") is True
        assert rollup.apply(changes, f"b{batch}") is False
        want = defaultdict(lambda: [0, 0])
        for source, lang, tokenizer, n in state.values():
            want[source, lang, tokenizer][0] += 1
            want[source, lang, tokenizer][1] += n
        for table in (rollup.totals(), rollup.recount()):
            assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in table.collect()} == dict(want)
    assert rollup.apply(spark.createDataFrame([], schema), "empty") is True
    assert len(token_rollup.TokenRollup(spark, str(tmp_path / "rollup")).commits()) == 6
    assert token_rollup.TokenRollup(spark, str(tmp_path / "new")).totals().collect() == []


def test_failed_attempt_is_invisible(spark, tmp_path):
    rollup = token_rollup.TokenRollup(spark, str(tmp_path / "r"))
    schema = "action string, doc_id long, source string, lang string, tokenizer string, n_tokens long"
    broken = spark.createDataFrame([("insert", 1, "s", "en", "t", 5)], schema).withColumn("n_tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        rollup.apply(broken, "b")
    assert rollup.totals().collect() == []
    assert rollup.apply(spark.createDataFrame([("insert", 1, "s", "en", "t", 5)], schema), "b")
    assert [tuple(r) for r in rollup.totals().collect()] == [("s", "en", "t", 1, 5)]


def test_token_counts(docs, vocabulary):
    library = Tokenizer.from_file(vocabulary)
    rows = [(1, "some words"), (2, None), (3, "x " * 500)]
    got = {r.doc_id: r.n_tokens for r in token_rollup.count_tokens(docs(rows, n_tokens=1), vocabulary).collect()}
    assert got == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in rows}
    assert np.sum(list(got.values())) > 0
