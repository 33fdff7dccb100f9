"""What several test modules share."""

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(df, cursor) -> None:
    """The Spark rows and the SQL rows are equal as bags, columns by name."""
    names = [x[0] for x in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    ours = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
