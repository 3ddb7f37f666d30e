import numpy as np

from sourcelode.llm import language_id as m

TEXT = {
    "en": "the house of the mayor is on a hill and it was built for the people that live in this town near the river with their children",
    "de": "das haus des bürgermeisters steht auf einem hügel und wurde für die menschen gebaut die in dieser stadt nahe dem fluss wohnen",
    "fr": "la maison du maire est sur une colline et elle a été construite pour les gens qui vivent dans cette ville près de la rivière",
}


def _docs(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(90):
        lang = list(TEXT)[i % 3]
        rows.append((i, " ".join(rng.permutation(TEXT[lang].split())), lang if i % 2 else lang.upper()))
    return spark.createDataFrame(rows + [(None, "x", "en"), (91, None, "de"), (92, "zz", None)], "doc_id long, text string, lang string")


def brute(pages, langs, tables):
    """The same posteriors row by row in numpy."""
    import re

    grams, rows = m.Trigrams(), []
    for page_id, url, html in pages:
        d = re.search(r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", html or "")
        h = re.match(r"[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = h[1].lower() if h else ""
        at = grams(m.visible(html or ""))
        like = tables[:, at].mean(axis=1).astype(float) * len(at) ** 0.5 if len(at) else np.zeros(len(langs))
        p = np.exp(like - like.max())
        says = d[1].lower() if d else ""
        rows.append((page_id, host, ".".join(host.split(".")[-2:]), host.split(".")[-1], says if says in (*langs, "") else "other", like, p / p.sum()))
    total, n = sum(r[6] for r in rows), len(langs)
    out = []
    for r in rows:
        prior = (total + m.SMOOTH) / (total.sum() + m.SMOOTH * n)
        for level in (3, 2, 1):
            own = np.maximum(sum(x[6] for x in rows if x[level] == r[level]) - r[6], 0)
            prior = (own + m.HOST_PULL * prior) / (own.sum() + m.HOST_PULL)
        said = (sum((x[6] for x in rows if x[4] == r[4]), np.zeros(n)) + m.SMOOTH) / (total + m.SMOOTH * (n + 2))
        post = np.log(prior) + np.log(said) + r[5]
        post = np.exp(post - post.max())
        out.append((str(r[0]), langs[int(post.argmax())], round(float(post.max() / post.sum()), 6)))
    return sorted(out)


def test_fusion_against_brute_force(spark):
    page = lambda lang, text: f'<!DOCTYPE html><html class="x" lang="{lang}"><head><style>p{{}}</style><script>var the="</p>";</script></head><body><p>{text}</p></body></html>'
    pages = []
    for i in range(60):
        lang = list(TEXT)[i % 3]
        said = "fr" if i == 4 else lang if i % 5 else "xx"
        pages.append((i, f"https://www.site{i % 7}.example.{ {'en': 'com', 'de': 'de', 'fr': 'fr'}[lang] }/p{i}", page(said, TEXT[lang])))
    pages += [(100, None, None), (101, "https://a.site0.example.de/x", ""), (102, "no url", "<p>la"), (None, "http://u@h.fr:80/", page("fr-CA", "maison")), (3, *pages[3][1:])]
    docs = _docs(spark)
    got = m.identify(spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, lang string"), docs).collect()
    langs, tables = m.learn(docs)
    assert langs == ["de", "en", "fr"]
    # hosts that end in .de and .example.de differ by suffix and domain only through the host itself
    assert sorted((str(r.page_id), r.lang, round(r.confidence, 6)) for r in got) == brute(pages, langs, tables)
    by = {r.page_id: r for r in got}
    assert all(by[i].lang == list(TEXT)[i % 3] for i in range(60)) and by[101].lang == "de" and by[100].text_lang is None


def test_empty_tables(spark):
    docs = _docs(spark)
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x")], "page_id long, url string, html string")
    assert m.identify(pages.limit(0), docs).count() == 0
    assert [(r.page_id, r.lang) for r in m.identify(pages, docs.limit(0)).collect()] == [(1, None)]
