"""Rows that every operator must handle: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = " ".join(f"word{i % 997} the of" for i in range(9000))
ROWS = [
    (1, "The cat and the dog of the house is in the garden with a ball that was on the table for you."),
    (2, None), (3, ""), (4, "  \t\n "), (5, "ab"), (5, "ab"), (6, "A b"), (None, "null id text of the day"), (None, None),
    (7, LONG), (8, "Der Hund und die Katze sind nicht im Haus, das ist für dich von mir mit der Post."),
    (9, 'token = "0123456789abcdef0123456789abcdef01234567" ends'), (9, "\U0001F600 \U0001F600́ x\x00y \x85 z"),
]
#: Extra columns with names that operators use inside.
EXTRA = "row string, h string, words string, id string, key string, n string, bucket string, fingerprint string"


def frame(spark, rows=ROWS, lang=False):
    kind = "doc_id long, text string" + (", lang string" if lang else "")
    data = [(*r, *(["en" if (r[0] or 0) != 8 else "de"] if lang else []), *["x"] * 8) for r in rows]
    return spark.createDataFrame(data, f"{kind}, {EXTRA}").repartition(3)


def order(rows):
    return sorted(rows, key=repr)
