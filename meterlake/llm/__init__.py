"""Operators for large training corpora: search, dedup, decontamination, language
models, tokenisation and text screening. Nothing outside this subpackage imports it.

Its Python functions travel to the executors by value, so a cluster needs no copy of
the package there (only numpy, pandas, xxhash and sentencepiece)."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
