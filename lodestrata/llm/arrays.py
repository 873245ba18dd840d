"""Arrays in files of the shared folder, mapped by the tasks that read them."""

from __future__ import annotations

import json
import mmap
import os
import shutil
import sys
import tempfile
import uuid

import numpy as np

from lodestrata.llm.token_files import open_store


def write_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes the arrays into one new file below ``folder``, after a header of their types, lengths and places; a task that is run again writes another file."""
    path = f"{folder}/{uuid.uuid4().hex}.arrays"
    store, root = open_store(path)
    store.create_dir(root.rsplit("/", 1)[0], recursive=True)
    head, end = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), end)
        end += a.nbytes + -a.nbytes % 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    with store.open_output_stream(root) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 64))
    return path


def reader(path: str):
    """name -> array of a file, mapped once and without an open descriptor; a file of another store is first copied to this machine, once."""
    from pyarrow import fs

    store, at = open_store(path)
    if not isinstance(store, fs.LocalFileSystem):
        copy = f"{tempfile.gettempdir()}/{at.rsplit('/', 1)[-1]}"
        if not os.path.exists(copy):
            part = f"{copy}.{uuid.uuid4().hex}"
            with store.open_input_stream(at) as src, open(part, "wb") as out:
                shutil.copyfileobj(src, out, 1 << 22)
            os.replace(part, copy)
        at = copy
    with open(at, "rb") as f:
        options = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        whole = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **options)
    start = 8 + int.from_bytes(whole[:8], "little")
    head = json.loads(whole[8:start])

    def load(name):
        dtype, n, place = head[name]
        return np.frombuffer(whole, dtype=dtype, count=n, offset=start + place) if n else np.empty(0, dtype=dtype)

    return load


def drop_folder(path: str) -> None:
    """Removes a folder that nothing reads any more."""
    store, root = open_store(path)
    store.delete_dir(root)
