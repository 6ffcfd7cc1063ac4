"""Training-data operators: token files, decontamination, near duplicates, line and byte deduplication, quality rules,
language-model scores, web-archive derivatives, secret scans and piece encoding.

Nothing outside this package imports it; its queries are in :mod:`loomtext.llm.queries`."""
