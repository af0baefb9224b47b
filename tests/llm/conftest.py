import random

import pytest

LONG_WORDS = 60_000
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def texts(seed=5):
    """Texts with every oddity: none, empty, blank, few words, copies, near copies, very long, secrets, notices."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeionrstlhd") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    base = words(120)
    near = base[:60] + ["changed"] + base[61:]
    passage = words(14)
    out = [None, "", " \t\n\x0b ", "one", "Four short Words here", "five words are just enough", "ÉÈ ñ 中文 😀 word\x00nul", "\n\n\n"]
    out += [" ".join(base), " ".join(base), " ".join(base).upper(), " ".join(near), " ".join(base[:90]), "  ".join(base)]
    out += [" ".join(words(40) + passage + words(40)), " ".join(passage[:9] + words(50)), " ".join(passage), ", ".join(words(30) + passage).title()]
    out += [" ".join(words(LONG_WORDS)), "x" * 700_000, " ".join(["the same three words"] * 60), "\n".join(["a line", "", "a line", "b", "a line"] * 12)]
    out += [f"{'é' * 30} {SECRET} and AKIA{'Q' * 16} near {'Ab3' * 14} https://host.example:80/x", f"{'Ab3' * 14} alone", "secret=token : abcdefgh api_KEY: 'abc' Password=abcdef", "😀" * 20 + " passwd: hunter2hunter2 " + "f" * 24 + "g" + "0" * 23]
    out += ["login = someone@example.com " + "pad " * 20 + SECRET, "login = someone " + "pad " * 90 + SECRET, "10.0.0.1 account: me api_key='0123456789abcdef'"]
    out += ["Licensed under the MIT Licence!", "text\nCopyright 2020 Someone\nAll rights reserved.\nReleased under the MIT license", " ".join(words(200)).replace("a", "%%%"), " | ".join(words(150))]
    out += [" ".join(words(n)) for n in (49, 50, 51, 99, 100, 101, 400)]
    return out, passage, words


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Tables with odd rows and with columns whose names clash with those that operators use."""
    path = str(tmp_path_factory.mktemp("tables"))
    found, passage, words = texts()
    langs, sources = ["en", "de", None, "xx"], ["src0", "src1", None, "é", "src0"]
    rows = [(i, t, langs[i % 4], sources[i % 5], len(t or ""), "x", 7, "y", i) for i, t in enumerate(found)]
    clash = ", size string, key int, node string, value long"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long" + clash).write.parquet(f"{path}/documents.parquet")
    items = [(0, " ".join(passage)), (1, "One"), (2, None), (3, ""), (4, " ".join(words(30))), (0, "four SHORT words"), (5, "--"), (6, " ".join(passage[2:13]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    urls = [None, "", "no scheme.com/en/", "http://com/en/x", "https://A.Example.COM/en/7?x", "http://example.com/en/70", "http://x.example.com/en", "http://net/de/", "ftp://b.example.net/de/8#a", "http://fakeorg/es/", "http://a.org/es/", "http://a.org/ES/", "http://www.spam-farm.example.org/en/1", "http://spam-farmer.org/", "http://cheap-pills.net/de/1", "://", "http://?q", "http://a.com\n/en/"]
    spark.createDataFrame([(i, u, "<p>", "z") for i, u in enumerate(urls + urls[3:6])], "page_id long, url string, html string, host string").write.parquet(f"{path}/pages.parquet")
    labels = [(i, 1, int(i % 3 == 0)) for i in range(0, len(found), 2)] + [(1, None, None), (None, 1, 1), (0, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="session")
def empty(spark, folder, tmp_path_factory):
    """The same tables without rows."""
    path = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "benchmark", "pages", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{path}/{name}.parquet")
    return path
