"""Status names of batch results, and the exceptions of scalar calls."""

from __future__ import annotations

SUCCESS, RESULT_TRUE, NOTFOUND, KEYEXIST, EMULTIVAL, EKEYMISMATCH = "SUCCESS", "RESULT_TRUE", "NOTFOUND", "KEYEXIST", "EMULTIVAL", "EKEYMISMATCH"
BAD_VALSIZE, INCOMPATIBLE, ENODATA, EINVAL, EACCESS, BAD_TXN, BUSY = "BAD_VALSIZE", "INCOMPATIBLE", "ENODATA", "EINVAL", "EACCESS", "BAD_TXN", "BUSY"
DBS_FULL, READERS_FULL, MAP_FULL, OUSTED, MVCC_RETARDED, TXN_OVERLAPPING, LAGGARD_READER = "DBS_FULL", "READERS_FULL", "MAP_FULL", "OUSTED", "MVCC_RETARDED", "TXN_OVERLAPPING", "LAGGARD_READER"

MEANING = {
    SUCCESS: "done", RESULT_TRUE: "done, with a flag raised", NOTFOUND: "no such key, pair or table", KEYEXIST: "the key or pair exists already",
    EMULTIVAL: "the key has several values", EKEYMISMATCH: "keys come out of order", BAD_VALSIZE: "a key or value has a wrong size", INCOMPATIBLE: "the table has other modes",
    ENODATA: "no position, or an empty range", EINVAL: "an argument makes no sense", EACCESS: "the transaction may only read", BAD_TXN: "the transaction is over or broken",
    BUSY: "another writer is at work", DBS_FULL: "too many tables", READERS_FULL: "too many readers", MAP_FULL: "no space left", OUSTED: "the snapshot was reclaimed",
    MVCC_RETARDED: "the snapshot is too old", TXN_OVERLAPPING: "this thread has a transaction already", LAGGARD_READER: "a reader holds old versions",
}


class StoreError(Exception):
    """A failed scalar call; ``code`` is one of the names above."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail or MEANING.get(code, code)}")
        self.code = code
