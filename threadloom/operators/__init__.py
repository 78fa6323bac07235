"""DataFrame operators: sessions, chunks, lexical and vector search, ranking, snippets, table maintenance."""
