"""A plug-in as a user may write one: rows of one part of a dataset from Parquet files."""


def pairs(config, split, part, parts):
    """(pair_id, words, split): every fifth count of words is for the test."""
    import pyarrow.dataset as ds
    import pyarrow.fs as pafs

    files, root = pafs.FileSystem.from_uri(config["path"])
    own = sorted(f.path for f in files.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".parquet"))[part::parts]
    for path in own:
        table = ds.dataset(path, filesystem=files).to_table()
        for pair_id, instruction in zip(table["pair_id"].to_pylist(), table["instruction"].to_pylist()):
            words = len((instruction or "").encode().split())
            if (words % 5 == 0) == (split == "test"):
                yield {"pair_id": pair_id, "words": words, "split": split}
