import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import markup, neighbors, residue


@pytest.mark.parametrize(
    "text",
    [
        "a <b>bold</b> word", "the <div broken", "an &nbsp;entity", "a &#8217; b", "**bold**", "> **open", "__strong words__", "~~gone~~", "`code`", "[text](../a.md)", "see [this][12]", "note[^3]", "x ### y",
        "a |---| b", "[[Page 3|it]]", "{{Note|x}}", "'''x'''", "{code}x{code}", "{color:red}x", "\\textbf{x}", "see~\\ref{sec:1}", "$\\frac{a}{b}$", "\\(x \\le 3\\)", "the == two words == end",
    ],
)
def test_marks(text):
    assert markup.residue_marks(f"The team said {text}")


@pytest.mark.parametrize(
    "text",
    [
        "latency < 120 ms and throughput > 60 rps", "a == b after 3 checks", "See C:\\data\\new_3 for files", "/v1/{tenant}/jobs", "x^12 or y_20", "R&D asked & got 8", "Map<String, List<Long>>", "2 * 5 * 45 in total",
        "*.log files", "codes [30] and [15]", "Issue #250", "Rates (120 | 750)", "about $12 to $2", "snake_case_name and other_name", "", None,
    ],
)
def test_no_marks(text):
    assert not markup.residue_marks(text)


def test_clean_text_keeps_structure():
    md = "# T\n\n- one **b**\n- two [x](y)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\nx = a **b\n```\n\n$$x^2$$\n\n<!-- c -->\nText &amp; more.\n"
    assert markup.render(markup.leaves(md)) == "# T\n\n- one b\n- two x\n\na | b\n1 | 2\n\n```\nx = a **b\n```\n\n$$ x^2 $$\n\nText & more."
    html = "<h2>Head</h2><ul><li>a</li><li>b <i>c</i></li></ul><table><tr><td>1</td><td>2</td></tr></table><pre><code>if a &lt; b:\n  c</code></pre><p>Para"
    assert markup.render(markup.leaves(html)) == "## Head\n\n- a\n- b c\n\n1 | 2\n\n```\nif a < b:\n  c\n```\n\nPara"
    tex = "\\section{Why}\n\\begin{itemize}\n\\item first \\emph{x}\n\\end{itemize}\n\\begin{verbatim}\na & b\n\\end{verbatim}\nBody \\cite{k} text"
    assert markup.render(markup.leaves(tex)) == "## Why\n\n- first x\n\n```\na & b\n```\n\nBody text"
    assert markup.leaves("") == [] and markup.render([]) == ""


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    model = markup.Labeller.fresh()
    x = rng.normal(0, 1, (3, 4, markup.INPUT)).astype(np.float64)
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 1, 1, 0]], np.float64)
    y = rng.integers(0, 7, (3, 4))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}

    def loss():
        p = model.probabilities(x, mask)
        return -(np.log(p[np.arange(3)[:, None], np.arange(4)[None, :], y]) * mask).sum() / mask.sum()

    at = markup.LABELS.index("residue")
    y[y == at] = 0
    grads = model.gradients(x, mask, y)
    for name in ("xf", "hf", "cf", "xb", "hb", "cb", "o", "p"):
        w = model.weights[name]
        place = tuple(0 for _ in w.shape)
        keep, step = w[place], 1e-4
        w[place] = keep + step
        up = loss()
        w[place] = keep - step
        down = loss()
        w[place] = keep
        assert abs((up - down) / (2 * step) - grads[name][place]) < 1e-4, name


SCHEMA = "repo string, id string, revision int, is_deleted boolean, summary_text string, raw_content string, text string, marks string"


def test_markup_queries(spark):
    clean = "ADR 0001: A title here\nStatus: accepted\nContext: The cache keeps <b sessions. It is {} fast."
    rows = [("r", f"{i:04d}", 1, False, f"ADR {i:04d}: Title\nStatus: accepted\nContext: The team keeps {'**sessions**' if i % 4 == 0 else 'sessions'} for {i} days. It works.", "# T\n\ntext", None, None) for i in range(60)]
    rows += [("r", "9000", 1, False, None, None, None, None), ("r", "9001", 1, False, "", "", None, None), ("r", "9002", 1, False, "`x`", "x", None, None), ("r", "9002", 2, True, None, None, None, None), ("r", "9003", 1, False, clean.replace("<b ", "").replace("{} ", ""), None, None, None)]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    got = sorted(r.id for r in markup.summaries_with_markup(df).collect())
    assert got == [f"{i:04d}" for i in range(0, 60, 4)]
    assert markup.clean_texts(df).count() == 60
    assert markup.summaries_with_markup(df.limit(0)).count() == 0 and markup.clean_texts(df.limit(0)).count() == 0


PLAIN_WORDS = "the broker keeps every record for ninety days and each tenant gets its own shard under load after a release".split()
OTHER_WORDS = "wir betreiben den dienst nachts damit die kosten sinken aber niemand braucht zugriff auf alte daten".split()


def _summaries(words, n, seed):
    rng = np.random.default_rng(seed)
    wraps = ("**{}**", "<b>{}</b>", "`{}`", "[[{}]]", "&lt;{}&gt;", "\\textbf{{{}}}", "~~{}~~", "[{}](http://x.y/z)", "<div {}", "== {} ==")
    plain = ("R&D asked for {} copies", "a < b and b > {}", "List<Long>> holds {}", "C:\\data\\new_{}", "Rates (2 | {}) are fixed", "retry_count_{}", "*.log and #{}", "cost is ${} today")
    out = []
    for i in range(n):
        text = [" ".join(rng.choice(words, 9)).capitalize() + "." for _ in range(5)]
        at = int(rng.integers(5))
        if i % 2:
            part = text[at].split()
            k = int(rng.integers(1, 7))
            part[k : k + 2] = [wraps[i // 2 % len(wraps)].format(" ".join(part[k : k + 2]))]
            text[at] = " ".join(part)
        else:
            text[at] += " " + plain[i // 2 % len(plain)].format(int(rng.integers(2, 90))).capitalize() + "."
        out.append(("ADR 0001: " + " ".join(text), bool(i % 2)))
    return out


def test_the_labeller_decides_also_on_unseen_words(spark):
    model = markup.fit_summaries([t for t, _ in _summaries(PLAIN_WORDS, 600, 1)])
    unseen = _summaries(OTHER_WORDS, 300, 2)
    df = spark.createDataFrame([("r", f"{i:04d}", 1, False, t, None) for i, (t, _) in enumerate(unseen)], "repo string, id string, revision int, is_deleted boolean, summary_text string, raw_content string")
    got = {int(r.id) for r in markup.summaries_with_markup(df, model=model).collect()}
    truth = {i for i, (_, marked) in enumerate(unseen) if marked}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.97 * len(got)
    constant = markup.Labeller({k: np.zeros_like(v) for k, v in model.weights.items()}, 0.5)
    assert markup.summaries_with_markup(df, model=constant).count() == 0


def test_clean_summaries(spark):
    from lodestone.llm import catalog

    broken = {
        "ADR 0001: T\nContext: on grafana <td>and one</td> on **rabbit.\nDecision: a == b == c": "ADR 0001: T\nContext: on grafana and one on rabbit.\nDecision: a b c",
        "Cost is $\\frac{a}{14}$ &nbsp;per `unit`": "Cost is a/14 per unit", "backward \\(load \\le 79\\) holds; > **details follow": "backward load ≤ 79 holds; details follow", "a [[Page|link]] and [text](x.md) <div class": None,
        "see {code}x{code} and [open](": None, "latency < 120 ms & 3 * 4 == 12": "latency < 120 ms & 3 * 4 == 12",
    }
    for text, want in broken.items():
        got = markup.clean_summary(text)
        assert not markup.residue_marks(got) and (want is None or got == want), (text, got)
    rows = [("r", f"{i:04d}", 1, False, text, "x", None, None) for i, text in enumerate(broken)] + [("r", "0000", 2, True, "`gone`", "x", None, None), ("r", "9", 1, False, None, "x", None, None)]
    assert "p6_clean_summaries" in catalog.QUERIES
    out = {r.id: r for r in markup.clean_summaries(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(out) == {f"{i:04d}" for i in range(1, len(broken))} and not any(markup.residue_marks(r.text) for r in out.values()) and out["0001"].marks


def brute_pairs(ids, x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in range(i) if s[i, j] >= least}


def test_similar_pairs_and_nearest(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (400, 64)).astype(np.float32)
    near = base[:60] + rng.normal(0, 0.05, (60, 64)).astype(np.float32)
    x = np.concatenate([base, near * 100, base[:5]])
    ids = [f"c{i:04d}" for i in range(len(x))]
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, x)]
    bad = [("null", None, ""), ("empty", [], ""), ("short", [1.0], ""), ("zero", [0.0] * 64, ""), ("nan", [float("nan")] * 64, ""), (None, x[0].tolist(), "")]
    df = spark.createDataFrame(rows + rows[:50] + bad, "chunk_id string, embedding array<float>, similarity string")
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neighbors.similar_pairs(df).collect()}
    assert got == brute_pairs(ids, x, 0.9)
    top = neighbors.nearest(df, k=5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = {ids[i]: {ids[j] for j in np.argsort(-s[i])[:5]} for i in range(len(ids))}
    found: dict = {}
    for r in top.collect():
        found.setdefault(r.chunk_id, set()).add(r.neighbor_id)
    assert set(found) == set(ids) and np.mean([len(found[i] & truth[i]) / 5 for i in ids]) >= 0.9
    assert neighbors.similar_pairs(df.limit(0)).count() == 0 and neighbors.similar_pairs(df.where("chunk_id IN ('null', 'zero')")).count() == 0


def test_near_copy_family_wider_than_a_beam(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, 64) + rng.normal(0, 0.02, (150, 64)), rng.normal(0, 1, (300, 64))]).astype(np.float32)
    ids = [f"c{i:03}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "chunk_id string, embedding array<float>")
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neighbors.similar_pairs(df).collect()}
    assert len(got) >= 150 * 149 // 2 and got == brute_pairs(ids, x, 0.9)


def test_cells_that_are_cut_again_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (6, 64))
    x = (base[rng.integers(0, 6, 1500)] + rng.normal(0, 0.5, (1500, 64))).astype(np.float32)
    x = np.concatenate([x, x[:300] + rng.normal(0, 0.1, (300, 64)), x[:3], x[:1] * np.arange(2, 500)[:, None]]).astype(np.float32)  # copies, and one direction that no centroid can cut
    ids = [f"c{i:05}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "chunk_id string, embedding array<float>")
    got = {(r.chunk_id_a, r.chunk_id_b) for r in neighbors.similar_pairs(df, cell_rows=64, most_cells=3).collect()}
    truth = brute_pairs(ids, x, 0.9)
    assert got <= brute_pairs(ids, x, 0.9 - 1e-6) and len(got & truth) >= 0.99 * len(truth)


def test_groups_and_links_of_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (3, 64))
    rows = [("a", x[0]), ("b", x[0]), ("c", x[0]), ("d", x[0] * 1.01 + 0.001 * x[1]), ("e", x[2]), ("a", x[0])]
    df = spark.createDataFrame([(i, [float(f) for f in v]) for i, v in rows], "chunk_id string, embedding array<float>")
    assert {tuple(r) for r in neighbors.vector_groups(df).collect()} == {("a", "a"), ("a", "b"), ("a", "c")}
    assert {tuple(r) for r in neighbors.similar_links(df).collect()} == {("a", "d")}
    assert {tuple(r) for r in neighbors.similar_pairs(df).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")}
    top = {(r.chunk_id, r["rank"]): r.neighbor_id for r in neighbors.nearest(df, k=2).collect()}
    assert top[("a", 1)] == "b" and top[("a", 2)] == "c" and top[("b", 1)] == "a" and top[("d", 1)] == "a" and top[("d", 2)] == "b" and ("e", 3) not in top


def test_graph_degrees_and_recall():
    rng = np.random.default_rng(2)
    centers = rng.normal(0, 1, (40, 64))
    x = neighbors.unit((centers[rng.integers(0, 40, 2000)] + rng.normal(0, 0.3, (2000, 64))).astype(np.float32))
    graph, best = neighbors.build_graph(x)
    assert graph.shape == (2000, int(neighbors.SLACK_FACTOR * neighbors.DEGREE)) and (best[1:] > 0).all() and all(i not in row for i, row in enumerate(graph[:50]))
    ids, _ = neighbors.beam_search(x, graph, x[:200], neighbors.entries(x, x[:200]), 24)
    truth = np.argsort(-(x[:200] @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(ids, truth)]) >= 0.9


@pytest.fixture(scope="module")
def residue_model():
    table = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["repo", "text"]).to_pylist()
    return residue.fit([(r["repo"] or "", r["text"]) for r in table if r["text"] and r["text"].strip()])


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("# Title\n\n[[insert context here]]", "placeholder"), ("Approved by {{ team name }} on Monday.", "placeholder"), ("Owner: <approver>", "placeholder"), ("FIXME describe the chosen option", "placeholder"),
        ("## Scope\n\nLorem ipsum dolor sit amet.", "filler"), ("1. ???", "filler"), ("(coming soon)", "filler"), ("n/a n/a n/a", "filler"), ("404 Page not found", "error"), ("ACCESS DENIED\nYou do not have permission to view this space.", "error"),
        ('{"status": 502, "error": "Bad gateway", "message": "The upstream server returned an invalid answer.", "trace": "a1"}', "error"), ("<noscript>You need to enable JavaScript to run this app.</noscript>", "error"),
        ("Traceback (most recent call last):\n  File \"export.py\", line 3, in run\nTimeoutError: page a1 not rendered", "error"), ("Payments Wiki » Sign in required\nSign in again to continue.\n#5e78524b\nHome | Search | Help", "error"),
    ],
)
def test_residue(residue_model, text, kind):
    assert residue_model.kinds([text]) == [kind]


@pytest.mark.parametrize(
    "text",
    [
        "The scaffolder replaces ${SERVICE_NAME} and ${OWNER} in new repositories within 30 seconds.", 'Reviewers reject drafts that still say "insert context here", about 12 per month.', "The service starts. Example:\n```\nhost: ${DB_HOST}\nport: {{ port }}\nretries: 60\n```\nThe cost stays flat.",
        "The record template has the fields [title] and [owner]; 12 percent of authors fill both.", "maps like {date} -> count", "Rendering `<%= title %>` twice cost us 12 ms.", "Seed data uses lorem ipsum paragraphs in tests.",
        "The error page Access denied is localised in 45 languages.", "A linter counts TODO and FIXME comments and fails above 3 of them.", "Before this change the portal required JavaScript; we now serve plain pages.", "", None, " \n",
    ],
)
def test_no_residue(residue_model, text):
    assert residue_model.kinds([text or ""]) == [None]


def test_residue_query(spark, residue_model):
    real = "# Cache\n\nThe team keeps sessions in the cache for {} days. Requests fall back to the ledger after a while, and the cost stays flat."
    rows = [(i, real.format(i) + (" Owner: {{team name}}." if i % 10 == 0 else ""), f"repo{i % 7}", None) for i in range(300)]
    rows += [(1000, None, None, None), (1001, "", "r", None), (1002, "503 Service unavailable", None, None), (1003, real.format(1) * 400 + "\n\n(asdf qwer asdf)", "r", None), (1004, " \n\x00", "r", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, repo string, kind string")
    got = {r.doc_id: r.kind for r in residue.judge(df, residue_model).collect()}
    assert got == {**{i: "placeholder" for i in range(0, 300, 10)}, 1002: "error", 1003: "filler"}
    assert residue.without_residue(df, residue_model).count() == len(rows) - len(got)
    assert residue.judge(df.limit(0)).count() == 0
    constant = residue.ResidueModel(np.zeros(residue.TABLE, np.float32), np.zeros(residue.TABLE, np.float32), (-9.0, -9.0), {})
    assert residue.judge(df, constant).count() == 0


def test_hosts_and_phrases_that_the_fit_has_not_seen(residue_model):
    report = residue_model.report
    assert report["held_documents"] > 300 and report["both"] >= 0.95 * report["weakly_labelled"]
    # none of these is among the weak labels
    pages = ["502 Bad gateway\nThe upstream server gave up.", "Sign in to continue\n\nThis page is for members. Please sign in again.", "Please turn on JavaScript to view this page."]
    assert residue_model.kinds(pages) == ["error"] * 3
    assert residue_model.kinds(["Approved by [[deputy manager]] on the new broker.", "Ticket: <%= cost centre %>"]) == ["placeholder"] * 2


def test_long_error_pages(residue_model):
    trace = "Traceback (most recent call last):\n" + "".join(f'  File "export.py", line {i}, in run\n' for i in range(90)) + "TimeoutError: page a1 not rendered"
    assert len(trace) > 1500 and residue_model.kinds([trace]) == ["error"]
    assert residue_model.kinds([trace + "\nThe team saw this 12 times in March, so exports now run at night. The broker keeps every record for ninety days." * 60]) == [None]


def test_labeller_reads_whole_documents():
    doc = [markup.Leaf("md/p", f"Line {i} of the record", "paragraph") for i in range(150)]
    model = markup.Labeller.fresh()
    whole = model.probabilities(*markup._padded([doc]))[0]
    got = model.label([doc[:3], [], doc])
    assert np.allclose(got[2], whole, atol=1e-6) and got[0].shape == (3, len(markup.LABELS)) and not len(got[1])
    long = " ".join(f"word{i}" for i in range(100))
    assert not np.array_equal(markup.features(markup.Leaf("p", long, "paragraph")), markup.features(markup.Leaf("p", long[:-1] + "8", "paragraph")))
