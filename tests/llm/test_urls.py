import itertools
import re
from collections import Counter
from math import log

from hearsay.llm import urls

DATA = "/root/testdata/sf0.001"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path, rules=urls.RULES):
    fits = [(r, v) for r, v in rules for name, start in [r.split("/", 1)] if (host == name or host.endswith("." + name)) and path.startswith("/" + start)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


ODD = [None, "", "no url", "://", "HTTP://A.COM/en/", "x://example.com/en/7?q=/", "x://notexample.com/en/7", "x://com/en/z#f", "x://a.example.net/de/8", "x://b.net/de/8", "x://É.ORG/es/É", "x://example.com?/en/", "x://a.com//en/", "://u@h.com:80/en/1://", "x://" + "ab" * 3000 + ".com/p", "x://spamfarm.net/q"]


def plain_words(html):
    """Words of html without scripts, styles and tags, by a plain scan."""
    html, out = (html or "").lower(), []
    while html:
        m = re.search(r"<(script|style)\b", html)
        out.append(html[: m.start()] if m else html)
        if not m:
            break
        end = html.find("</" + m[1], m.end())
        html = html[end:] if end >= 0 else ""
    return re.findall("[a-z]+", re.sub(r"<[^<>]*>", " ", " ".join(out)))


def best_split(name, counts, total):
    """By trying every split point of every prefix."""
    best = [(0.0, [])]
    for end in range(1, len(name) + 1):
        found = []
        for k in range(end):
            n = counts[name[k:end]]
            found.append((best[k][0] + (-log(n / (total + 1)) if n else log(total + 2) + 2.3 * (end - k)), k))
        cost, k = min(found)
        best.append((cost, [*best[k][1], name[k:end]]))
    return best[-1][1]


def split_all(text, counts, total):
    return [w for t in re.findall("[a-z]+|[0-9]+", text) for w in (best_split(t, counts, total) if t.isalpha() else ["#"])]


def brute(pages, held, rules=urls.RULES, labels=None):
    """(host, path, rule, verdict, words, score) of each page. held: hosts that are held out."""
    counts = Counter(w for _, _, html in pages for w in plain_words(html))
    total = sum(counts.values())

    def words_of(host, path):
        return split_all(host, counts, total) + ["/" + (t if t.isalpha() else "#") for t in re.findall("[a-z]+|[0-9]+", path.lower())]

    rows, examples = [], []
    for _, url, _ in pages:
        host, path = parts(url)
        rule, verdict = ruled(host, path, rules)
        if rule:
            name, start = rule.split("/", 1)
            words = words_of(host[: max(0, len(host) - len(name) - 1)], path[len(start) + 1 :])
            if labels is None and host not in held:
                examples.append((words, verdict == "block"))
        else:
            words = words_of(".".join(host.split(".")[:-1]) if "." in host else host, path)
        rows.append((host, path, rule, verdict, words))
    for url, blocked in labels or ():
        host, path = parts(url)
        if host not in held:
            examples.append((words_of(".".join(host.split(".")[:-1]) if "." in host else host, path), blocked))
    seen = {c: Counter(w for words, b in examples if b == c for w in words) for c in (False, True)}
    known, n = set(seen[False]) | set(seen[True]), {c: sum(b == c for _, b in examples) for c in (False, True)}
    some = n[True] and n[False]

    def weight(w):
        p, q = ((seen[c][w] + urls.SMOOTHING) / (sum(seen[c].values()) + urls.SMOOTHING * len(known) + 1e-9) for c in (True, False))
        return log(p) - log(q)

    out = []
    for host, path, rule, verdict, words in rows:
        score = log((n[True] + 1) / (n[False] + 1)) + sum(weight(w) for w in words if w in known) if some else 0.0
        out.append((host, path, rule, verdict or ("block" if score > log(9) else "allow"), words, score))
    return out


def check(pages, found, **more):
    held = {r.host for r in found if r.held_out}
    want = Counter()
    for (page_id, _, _), (host, path, rule, verdict, words, score) in zip(pages, brute(pages, held, **more)):
        want[str((page_id, host, path, rule, verdict, words, f"{score:.6f}"))] += 1
    got = Counter(str((r.page_id, r.host, r.path, r.rule, r.verdict, list(r.words), f"{r.score:.6f}")) for r in found)
    assert got == want
    return held


def test_hosts_paths_and_rules(spark):
    rows = [(k, u, "<p>spam farm words</p><script>not</script>", "x") for k, u in enumerate(ODD)] + [(None, None, None, "x"), (3, ODD[3], None, "x")]
    found = urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    assert len(found) == len(rows)
    check([r[:3] for r in rows], found)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judged(none).count() == 0


def test_query_against_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url", "html").collect()]
    found = urls.query(spark, DATA).collect()
    assert len(found) == len(pages)
    held = check(pages, found)
    assert 0 < len(held) < len({r.host for r in found}) / 2 and len({r.score for r in found}) > 10


def test_segmentation_is_the_most_probable():
    grams = urls.WordCounts({"spam": 50, "farm": 40, "far": 90, "ms": 3, "s": 5, "pa": 9, "unquestionablyextraordinary": 2}, 300)
    assert grams.segment("spamfarms") in (["spam", "farm", "s"], ["spam", "far", "ms"])
    assert grams.segment("spamunquestionablyextraordinary") == ["spam", "unquestionablyextraordinary"]
    for name in ("spamfarm", "farspa", "xq", "xspamq", "sss", ""):
        splits = [[name[a:b] for a, b in itertools.pairwise([0, *cut, len(name)])] for n in range(len(name)) for cut in itertools.combinations(range(1, len(name)), n)] or [[]]
        best = min(sum(map(grams.cost, s)) for s in splits)
        assert abs(sum(map(grams.cost, grams.segment(name))) - best) < 1e-9


def test_unseen_hosts_are_judged_by_their_words(spark):
    words = "<p>" + "spam farm casino shop news green river stone tree " * 5 + "</p>"
    sites = [f"{a}{b}{n}" for n in ("", "1", "2") for a, b in itertools.product(["green", "river", "stone"], ["tree", "news", "shop"])], [f"{a}{b}{n}" for n in ("", "1", "2") for a, b in itertools.product(["casino", "spam"], ["farm", "casino", "spam"])]
    labels = [(f"http://{host}.com/x", bool(k)) for k in (0, 1) for host in sites[k]] + [(None, True), ("http://a.com/", None)]
    pages = [(k, f"http://www.{host}.net/q", words) for k, host in enumerate(["greenriver", "stonestone", "newsshop", "casinospam9", "spamspam9", "farmcasino9"])]
    found = urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=(), labels=spark.createDataFrame(labels, "url string, blocked boolean")).collect()
    hosts = {host for k in (0, 1) for host in sites[k]}
    held = {r.host for r in spark.createDataFrame([(f"{h}.com",) for h in hosts], "host string").where("pmod(xxhash64(host), 5) = 0").collect()}
    want = brute(pages, held, rules=(), labels=[x for x in labels if None not in x])
    for r in found:
        assert (r.verdict, list(r.words), round(r.score, 6)) == (want[r.page_id][3], want[r.page_id][4], round(want[r.page_id][5], 6))
        assert (r.verdict == "block") == (r.page_id > 2)
    assert any("casino" in r.words for r in found)
    assert urls.visible("<Script>x</script>A<style>b").split() == ["a"]


def test_rules_teach_what_is_beside_them_and_a_fifth_of_hosts_is_held_out(spark):
    words = "<p>" + "good news bad deals site " * 5 + "</p>"
    pages = [(k, f"http://{'baddeals' if k % 2 else 'goodnews'}{k}.{'com/en' if k % 2 else 'net/de'}/p/{k}", words) for k in range(200)]
    pages += [(1000, "http://baddealssite.org/p/1", words), (1001, "http://goodnewssite.org/p/1", words)]
    found = urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = {r.page_id: r for r in found.collect()}
    assert rows[1000].verdict == "block" and rows[1001].verdict == "allow" and "com" not in rows[1].words and "/en" not in rows[1].words
    accuracy, n = urls.held_out_accuracy(found)
    assert accuracy == 1 and 20 < n < 70


def words_but(avoid=()):
    return (w for n in range(3, 6) for w in map("".join, itertools.product("bcdfghjklmnpqrstvwxz", repeat=n)) if w not in avoid)


def test_counts_of_other_words_do_not_count_as_a_host_s(spark):
    html = "<p>" + "river stone " * 5 + " ".join(f"{w} " * 3 for w in itertools.islice(words_but(), 20_000)) + "</p>"
    found = urls.judged(spark.createDataFrame([(1, "http://riverstone.com/x", html)], "page_id long, url string, html string")).collect()
    assert found[0].words == ["river", "stone", "/x"]


def test_no_word_takes_the_weight_of_another(spark):
    other = itertools.islice(words_but(), 3000)
    labels = [(f"http://site{k}.com/prize/{k}", True) for k in range(60)] + [(f"http://green{k}.com/{w}/{k}", False) for k, w in enumerate(other)]
    pages = [(200, "http://tree.com/prize", "<p>green site tree</p>"), (201, "http://tree.com/bbc", None)]
    score = {r.page_id: r.score for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), rules=(), labels=spark.createDataFrame(labels, "url string, blocked boolean")).collect()}
    assert score[200] > score[201] + 4
