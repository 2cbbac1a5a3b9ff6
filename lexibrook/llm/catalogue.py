"""The queries of this subpackage and their SQL, by name."""

from lexibrook.llm import chat, embeddings, langid, licences, media, mixing, packing, rans, simhash, warc

MODULES = (packing, embeddings, warc, media, chat, langid, mixing, rans, licences, simhash)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
