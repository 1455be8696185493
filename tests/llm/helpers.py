"""Inputs that every operator has to bear: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, score double, node long, shard int, mix_key string, "
        "stats string, hit string, n_shingles long, held_out string, h string, benchmark_hit string")
WORDS = "the of and to in is that for it with der die und von zu den la de que el en los le et des un".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(["", "", "a", "ing", "tion", "x"])) for _ in range(n))


def edge_rows():
    rng = random.Random(4)
    base = sentence(rng, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, " ".join(near), "", None, "   \n\t ", "one", "two words", sentence(rng, 30000), "x" * 50000, "Ünïcode ñandú 日本語   end",
             sentence(rng, 40), sentence(rng, 40), "a b c d e f g h i j k", "THE THE THE!! || %%%"]
    rows = [(i, t, "en", f"src{i % 3}", len(t or ""), 0.5, 1, 2, "k", "s", "h", 3, "o", "h", "b") for i, t in enumerate(texts)]
    rows.append((None, base, None, None, None, None, None, None, None, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None, None, None, None, None, None, None, None))
    return rows + [rows[0], rows[3], rows[4], rows[11], rows[-2]]  # repeated rows


def edge_docs(spark, rows=None):
    return spark.createDataFrame(edge_rows() if rows is None else rows, DOCS)


def tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
