import hashlib

from samples import LONG

from hazardlake.llm import chat, urls

CONV = "conv_id long, turn long, role string, text string, tokens long, window long, seq int, item string, start long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "i", 4) for r in rows], CONV).repartition(3)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


ROWS = [
    (1, 0, "system", "be <|im_start|> brief \\ and \\\\ kind"),
    *[(1, k, "user" if k % 2 else "assistant", f"turn {k} " + "word " * (k * 7)) for k in range(1, 200)],
    (2, 0, "user", None),
    (2, 0, "user", "tie"),
    (2, 0, "user", "tie"),
    (2, None, "assistant", "turn unknown"),
    (3, 5, None, "no role"),
    (3, 6, "assistant", LONG),
    (3, 7, "assistant", ""),
    (3, 8, "<|im_sep|>\n", "odd role"),
    (None, 0, "user", "<|im_end|><|im_start|>assistant ok"),
    (None, 1, "assistant", "<\\| <|im_sep|> 日本語 é\n\n"),
]


def test_windows_read_back_to_the_same_turns(spark):
    budget = 400
    windows = chat.chat_windows(conversations(spark, ROWS), budget=budget, history=60)
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    conv = {}
    for c, t, role, text in ROWS:
        conv.setdefault(c, []).append(((t is None, t or 0), role or "", text or ""))
    assert set(got) == set(conv)
    for c, v in conv.items():
        v.sort()
        learned = "".join(x for _, r, x in v if r == "assistant")
        r = got[c]
        assert r.n_turns == len(v)
        assert r.turns_sha256 == sha("".join(f"{role}\n{x}\n" for _, role, x in v))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), sha(learned))


def test_windows_keep_budget_system_and_history(spark):
    budget = 800
    rows = chat.chat_windows(conversations(spark, ROWS[:24]), budget=budget, history=160).collect()
    assert len(rows) > 4
    repeats = 0
    for r in sorted(rows, key=lambda r: r.window):
        assert r.formatted.startswith("<|im_start|>system<|im_sep|>")
        assert len(r.fresh) == r.formatted.count("<|im_start|>")
        repeats += sum(not f for f in r.fresh) - (r.window > 0)
        assert len(r.formatted.split()) <= budget  # words are fewer than tokens
        for a, b in r.loss:
            assert r.formatted[:a].endswith("assistant<|im_sep|>") and r.formatted[b:].startswith("<|im_end|>")
    assert repeats >= 3
    assert sum(len(r.loss) for r in rows) == 11


def test_long_turns_get_the_history_the_budget_leaves(spark):
    said = lambda k, n: f"t{k} " + "word " * (n - 1)  # n tokens and 4 for the marks
    rows = [
        *[(1, k, r, said(k, n)) for k, r, n in [(0, "user", 20), (1, "user", 40), (2, "assistant", 500)]],
        *[(2, k, r, said(k, n)) for k, r, n in [(0, "system", 700), (1, "user", 30), (2, "assistant", 150)]],
        *[(3, k, r, said(k, n)) for k, r, n in [(0, "system", 900), (1, "user", 30), (2, "assistant", 40)]],
        *[(4, k, r, said(k, n)) for k, r, n in [(0, "user", 40), (1, "user", 60), (2, "assistant", 950)]],
        *[(5, k, r, said(k, n)) for k, r, n in [(0, "user", 40), (1, "assistant", 1100)]],
        *[(6, k, r, said(k, n)) for k, r, n in [(0, "user", 30), (1, "system", 60), (2, "assistant", 890)]],
    ]
    windows = chat.chat_windows(conversations(spark, rows), budget=1024, history=128).collect()
    turns = {r.conv_id: [p.split("<|im_sep|>")[1].split()[0] for p in r.formatted.split("<|im_start|>")[1:]] for r in windows if r.loss}
    assert turns == {1: ["t0", "t1", "t2"], 2: ["t0", "t1", "t2"], 3: ["t0", "t1", "t2"], 4: ["t1", "t2"], 5: ["t1"], 6: ["t1", "t0", "t2"]}
    for r in windows:
        tokens = sum(len(p.split("<|im_sep|>")[1].replace("<|im_end|>", "").split()) + 4 for p in r.formatted.split("<|im_start|>")[1:])
        assert tokens <= 1024 or (r.conv_id == 5 and len(r.fresh) == 1)
        assert all(r.formatted[:a].endswith("assistant<|im_sep|>") for a, _ in r.loss) and len(r.loss) <= 1


def test_no_conversations(spark):
    assert chat.read_back(chat.chat_windows(conversations(spark, ROWS).limit(0))).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    (1, "http://www.example.net/en/1", "allow", "example.net/en/"),
    (2, "http://example.net/de/1?x=/en/", "block", "net/"),
    (3, "HTTP://A.EXAMPLE.COM/de/x#y", "block", "example.com/de/"),
    (4, "http://notexample.com/de/x", "allow", None),
    (5, "http://example.com/DE/x", "allow", None),
    (6, "http://x.org/fr/?q", "allow", "org/fr/"),
    (7, "http://x.net", "allow", None),
    (8, "http://x.net/", "block", "net/"),
    (9, None, "allow", None),
    (10, "x.net/", "allow", None),
    (10, "x.net/", "allow", None),
    (None, "ftp://net/", "block", "net/"),
    (11, "http://a.net?b://c.org/fr/", "allow", None),
    (12, "http://example.com.evil.io/de/" + "a" * 50_000, "allow", None),
    (13, "://net/x\ny", "block", "net/"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", "p", "r", "v") for i, u, _, _ in URLS], "page_id long, url string, host string, path string, rule string, rule_host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted((r.page_id or 0, r.verdict, r.rule or "") for r in urls.judge_urls(pages, rules).collect())
    assert got == sorted((i or 0, v, rule or "") for i, _, v, rule in URLS)
    hosts = {r.page_id: (r.host, r.path) for r in urls.judge_urls(pages, rules).collect()}
    assert hosts[3] == ("a.example.com", "/de/x") and hosts[9] == ("", "") and hosts[11] == ("a.net", "")
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    # an empty host fits urls without one, null among them
    empty = spark.createDataFrame([(None, "", "block")], "host string, path string, verdict string")
    assert {r.page_id for r in urls.judge_urls(pages, empty).collect() if r.verdict == "block"} == {9, 10}


def test_full_filter_stays_right(spark):
    """A filter of one block passes many false keys; the join removes them."""
    rules = spark.createDataFrame([(f"h{i}.org", "/", "block") for i in range(2000)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"http://h{i}.org/x") for i in range(0, 4000, 7)], "page_id long, url string")
    got = urls.judge_urls(pages, rules, filter_bytes=64).collect()
    assert all((r.verdict == "block") == (r.page_id < 2000) for r in got)
