"""The registered queries, and the same in DuckDB SQL."""

from fluxtone.plans import codecs, containers, dsp, lossless, packets, spectral, speech, streams

_PARTS = (dsp, codecs, spectral, lossless, speech, packets, containers, streams)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE = {k: v for part in _PARTS for k, v in part.ORACLE.items()}
