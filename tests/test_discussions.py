"""Discussion terms and link suggestions against plain Python over whole crawls."""

import random
import re

from pyspark.sql import functions as F

from sitemetry.functions.text import STOPWORDS
from sitemetry.operators import content, discussions

VOCABULARY = "tip calculator percent bill split travel country guide free best rates the and to 12 ab restaurant waiter euro".split()
PAGES = "crawl_run_id string, page_id string, page_seq long, url string, title string, meta_description string, status_code int, content_type string"


def crawls(seed, n=14):
    r = random.Random(seed)
    phrase = lambda most: " ".join(r.choice(VOCABULARY) for _ in range(r.randrange(0, most)))
    pages, asked = [], []
    for crawl in ("a", "b"):
        for i in range(n):
            title = r.choice([None, phrase(7).title(), f" {phrase(4)} ", phrase(4)])
            pages.append((crawl, f"{crawl}{i}", i, f"https://{crawl}.org/{r.choice(['', 'x/'])}{phrase(5).replace(' ', '-')}", title, r.choice([None, phrase(9)]), r.choice([200, 200, 200, 404]), r.choice(["text/html", "text/html", "application/pdf"])))
        asked += [(crawl, phrase(4).upper(), r.choice(["CONTENT_GAP", "SEARCH_INTENT_GAP", "WEAK_TOPIC_COVERAGE", "OTHER"])) for _ in range(6)]
    return pages, asked


def tokens(text):
    words = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s-]", " ", text.lower())).strip().split()
    return [w for w in words if len(w) >= 3 and not w.isdigit() and w not in STOPWORDS]


def slug(url):
    path = re.match(r"[a-z]+://[^/]*(/[^?#]*)?", url)[1] or "/"
    return re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9\s-]", " ", re.sub("[_-]+", " ", path))).strip()


def brute_terms(pages, asked):
    """{(crawl, term): [tokens, pages, dedicated, kind]} in the order of pages."""
    found = {}

    def note(crawl, term, words, page, dedicated, kind):
        if len(term) >= 3:
            entry = found.setdefault((crawl, term), [words, set(), False, kind])
            entry[1].add(page)
            entry[2] |= dedicated
            entry[3] = max(entry[3], kind)

    for crawl, page, _, url, title, meta, status, kind in pages:
        fields = [(slug(url), True, 1, 5)]
        if status == 200 and kind == "text/html":
            fields += [(title or "", True, 2, 4), (meta or "", False, 1, 0)]
        for text, _, least, most in fields[:2]:
            if least <= len(tokens(text)) <= most and len(text.strip()) <= 40:
                note(crawl, text.strip().lower(), tokens(text), page, True, discussions.PHRASE)
        for text, dedicated, *_ in fields:
            words = tokens(text)
            for w in words:
                note(crawl, w, [w], page, dedicated, discussions.SINGLE)
            for pair in zip(words, words[1:], strict=False):
                note(crawl, " ".join(pair), list(pair), page, dedicated, discussions.BIGRAM)
    for crawl, query, kind in asked:
        term = query.strip().lower()
        if kind != "OTHER" and tokens(term):
            if (crawl, term) in found:
                found[crawl, term][3] = discussions.OPPORTUNITY
            else:
                found[crawl, term] = [tokens(term), set(), True, discussions.OPPORTUNITY]
    return found


def brute_kept(found):
    general = set(discussions.GENERAL)
    pairs = {(crawl, p) for (crawl, _), (words, _, _, kind) in found.items() if kind == discussions.PHRASE for p in zip(words, words[1:], strict=False)}
    out = {}
    for (crawl, term), entry in found.items():
        words, kind = entry[0], entry[3]
        noise = term in general if kind == discussions.SINGLE else all(w in general for w in words)
        if not noise and not (kind == discussions.BIGRAM and (crawl, tuple(words)) in pairs):
            out[crawl, term] = entry
    return out


def brute_score(entry):
    words, pages, dedicated, kind = entry
    general = [w in discussions.GENERAL for w in words]
    extra = {discussions.OPPORTUNITY: 50, discussions.PHRASE: 15 if any(general) else 30, discussions.BIGRAM: (5 if general[0] else 10) if any(general) else 25, discussions.SINGLE: 0 if any(general) else 5}
    return 20 * len(pages) + 10 * dedicated + extra[kind]


def test_terms_noise_queries_and_core_terms(spark):
    for seed in range(3):
        pages, asked = crawls(seed)
        terms = discussions.discussion_terms(spark.createDataFrame(pages, PAGES), spark.createDataFrame(asked, "crawl_run_id string, query string, opportunity_type string")).cache()
        found = brute_terms(pages, asked)
        row = lambda r: (r["doc_freq"], r["dedicated"], r["kind"])
        assert {(r["crawl_run_id"], r["term"]): row(r) for r in terms.collect()} == {k: (len(p), d, kind) for k, (_, p, d, kind) in found.items()}
        kept = discussions.noise_filter(terms)
        want = brute_kept(found)
        assert {(r["crawl_run_id"], r["term"]) for r in kept.collect()} == set(want)
        scores = {k: brute_score(e) for k, e in want.items()}
        ranked = [(c, i + 1, t, s, len(want[c, t][1]) >= 2) for c in "ab" for i, (s, t) in enumerate(sorted(((s, t) for (x, t), s in scores.items() if x == c), key=lambda x: (-x[0], x[1]))[:8])]
        assert sorted(map(tuple, discussions.rank_discussion_queries(kept).collect())) == ranked
        assert sorted(map(tuple, discussions.core_discussion_terms(kept).collect())) == sorted((c, t, scores[c, t]) for (c, t), e in want.items() if len(e[1]) >= 2)
        assert len([1 for e in want.values() if len(e[1]) >= 2]) > 8


def test_link_suggestions_over_all_pairs(spark):
    for seed in range(3):
        r = random.Random(seed)
        words = "tipping travel wine cheese".split()
        pages = [("c", i, f"https://c.org/{r.choice(words)}-{i}", r.choice([None, r.choice(words).upper() + " page"])) for i in range(12)]
        pages.append(("c", 12, "https://c.org/wine-3/", None))  # the same page by its key, if there is one
        plan = [("c", 1, "Wine and cheese"), ("c", 2, "the tipping"), ("c", 3, "to go"), ("d", 1, "wine")]
        key = lambda url: re.sub("^https://", "", url).rstrip("/")
        edges = {("c", key(r.choice(pages)[2]), key(r.choice(pages)[2])) for _ in range(40)}
        got = content.content_link_suggestions(
            spark.createDataFrame(plan, "crawl_run_id string, place int, topic string"),
            spark.createDataFrame(pages, "crawl_run_id string, page_seq int, url string, title string"),
            spark.createDataFrame(sorted(edges), "crawl_run_id string, source string, target string"),
        )
        want, seen = [], set()
        for _, place, topic in plan[:3]:
            long_words = [w for w in re.split("[^a-z0-9]+", topic.lower()) if len(w) > 3]
            hits = {}
            for _, seq, url, title in pages:
                if any(w in f"{(title or '').lower()} {url}" for w in long_words):
                    hits.setdefault(key(url), seq)
            ordered = sorted(hits, key=lambda k: (hits[k], k))
            for i, a in enumerate(ordered):
                for b in ordered[i + 1 :]:
                    if ("c", a, b) not in edges and ("c", b, a) not in edges and frozenset((a, b)) not in seen:
                        seen.add(frozenset((a, b)))
                        want.append((a, b, topic))
        assert [(x["source"], x["target"], x["topic"]) for x in got.orderBy("place").collect()] == want[:8]


def test_core_words_count_for_posts_of_their_crawl(spark):
    from datetime import datetime

    posts = [("c", "wine tips", "Wine tasting for waiters", "wine wine", "me", 5, 3, datetime(2024, 1, 1), "s"), ("d", "wine tips", "Wine tasting for waiters", "wine wine", "me", 5, 3, datetime(2024, 1, 1), "s"), ("c", "", "", None, None, 0, 0, None, "s")] * 2
    df = spark.createDataFrame(posts, "crawl_run_id string, query string, title string, body_snippet string, author string, score int, num_comments int, created_at timestamp, subreddit string")
    core = spark.createDataFrame([("c", "wine waiters"), ("c", "wine"), ("d", "beer")], "crawl_run_id string, term string")
    got = discussions.score_discussions(df, core, datetime(2024, 1, 2)).groupBy("crawl_run_id", "query", "relevance").agg(F.count(F.lit(1)).alias("n")).collect()
    assert sorted(map(tuple, got)) == [("c", "", 8, 2), ("c", "wine tips", 26, 2), ("d", "wine tips", 14, 2)]
