"""Documents with every awkward case: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, shard string, fp string, score string, _key string, start string, offset string"


def word(rnd):
    return "".join(rnd.choice(["ka", "lo", "mi", "ter", "sun", "é", "ß", "an"]) for _ in range(rnd.randrange(1, 4)))


def texts(seed=5, n=60):
    rnd = random.Random(seed)
    vocabulary = [word(rnd) for _ in range(120)]
    out = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(5, 90))) for _ in range(n)]
    out += [out[0], out[0], out[1] + " extra", "", "   \n\t ", "A", "a b c", "İstanbul ΣΑΣ ﬁn", "tab\tand\x0bother\x0cspace\x1cx\x85y z", "12345 67890", "🙂 emoji 🙂", "see <|endoftext|> here <|STARTOFTEXT|>", " ".join(rnd.choice(vocabulary) for _ in range(20000))]
    return out


def rows():
    t = texts()
    out = [(i, x, ("en", "fr", None)[i % 3], "s", len(x), "k", "x", "f", "9", "k", "s", "o") for i, x in enumerate(t)]
    out += [out[3], (None, " ".join(reversed(t[7].split())), None, None, None, None, None, None, None, None, None, None), (500, None, "en", None, None, None, None, None, None, None, None, None)]
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def saved(spark, path):
    """A folder with the tables that the queries read."""
    documents(spark).write.mode("overwrite").parquet(f"{path}/documents.parquet")
    items = spark.createDataFrame([(1, " ".join(texts()[2].split()[:14])), (2, "A"), (3, None), (4, ""), (2, "a b"), (None, texts()[4])], "item_id long, text string")
    items.write.mode("overwrite").parquet(f"{path}/benchmark.parquet")
    urls = ["https://A.Example.com/en/70?x", "http://example.com/en/8#t", "https://net/de/1", "https://x.example.net/de/8/2", "ftp://org/es/", "no scheme/en/", None, "https://org/fr/", "://com/en/", "https://com.au/en/", "https://a..com/en/1", "https://x.example.net/de/8/2"]
    spark.createDataFrame([(i, u, "<p>", "h", "v") for i, u in enumerate(urls)], "page_id long, url string, html string, host string, verdict string").write.mode("overwrite").parquet(f"{path}/pages.parquet")
    return path
