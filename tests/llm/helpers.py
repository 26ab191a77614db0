"""Small document tables with the odd cases that every operator must define."""

#: Extra columns have names that operators might give to columns of their own.
EXTRA = ("score", "hits", "found", "base", "every", "wide", "none", "id", "th", "key", "k0", "m0", "merged", "__hits", "__p", "__base", "__all", "__c", "__key")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def frame(spark, texts, langs=None, first=0):
    rows = [(first + i, t, langs[i] if langs else None, "s", None if t is None else len(t), *EXTRA) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


#: Null, empty, blank, short, long, repeated and non-Latin texts.
ODD = [None, "", " \n\t", "a", "a", "é😀 ß", "word " * 4000, "x" * 5000, "same text here\nsame text here", "same text here\nsame text here", "日本語のテキスト"]


def unchanged(docs, out):
    """Whether the extra columns came through as they were."""
    return out.columns == docs.columns and out.dtypes == docs.dtypes and all(tuple(x[c] for c in EXTRA) == EXTRA for x in out.select(*EXTRA).distinct().collect())
