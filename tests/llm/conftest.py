import random

import pytest

PASSAGE = " ".join(f"passage{i % 23}x{i}" for i in range(60))


def _texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    copies = prose(300)
    return [
        None, "", " \t\n\r ", "one", "one two", "Ünïcode 😀 word 😀 +49 170 1234567 end", copies, copies, copies + " tail", copies.upper(), PASSAGE, prose(50) + " " + PASSAGE + " " + prose(40), "a " * 200, "a b " * 90,
        "mail me at jane.doe+x@mail.example.org or 10.0.0.255 or 999.1.1.1", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 phone +1 (555) 010-9999.", "x@y.z@w.v 1.2.3.4.5.6.7.8 call 030-1234-5678 or bob (at) corp (dot) com",
        "line\nline\nline\n\n \nother # * $ % line", prose(30_000), prose(20) + "\n" + prose(20), "!!! ### $$$ %%% &&& *** ||| <<< >>> ### !!! ???", "it's-a-test," * 400, "\x00\x01 control \x7f words\x0b here",
    ]


@pytest.fixture(scope="session")
def odd_dir(tmp_path_factory, spark):
    """Tables with nulls, empty and long texts, copies, ties, repeated rows and columns of clashing names."""
    out = str(tmp_path_factory.mktemp("odd"))
    texts = _texts()
    rows = [(i, t, "en" if i % 2 else None, [None, "web", "hot", "hot", "hot"][i % 5], i, "f", "b", 0.5, "k") for i, t in enumerate(texts)]
    rows += [rows[6]]  # repeated row
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, block string, score double, uid string").write.parquet(f"{out}/documents.parquet")
    items = [(1, PASSAGE), (2, "one two"), (3, None), (4, ""), (1, PASSAGE), (None, "control words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(len(texts))] + [(0, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    urls = [None, "", "no scheme", "http://", "https://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://sub.www.example.com/en/a", "http://foo.net/es/1", "http://foo.net/EN/", "http://com/", "ftp://x.org", "http://a.com?q=/", "http://ünï.net/fr/ü", "a://b://c.com/d", "http://example.com/en/" + "x" * 5000, "http://foo.net/de/1\nhttp://x.com/"]
    pages = [(i, u, "h", "host", 1.0) for i, u in enumerate(urls + urls[4:6])]
    spark.createDataFrame(pages, "page_id long, url string, host string, verdict string, score double").write.parquet(f"{out}/pages.parquet")
    return out


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory, spark, sf_dir):
    out = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{out}/{t}.parquet")
    return out
