"""ascribe — Spark-native attribution-bias auditing.

Trial generation (templates x names), deterministic option permutation,
choice / likelihood / perplexity scoring from caller-supplied scores, and
disparity statistics over demographic and prompt dimensions, expressed as
DataFrame plans that Catalyst optimises and that scale with the input tables.
"""

__version__ = "0.1.0"
