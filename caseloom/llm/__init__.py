"""Training-corpus operators: de-duplication, decontamination, filters, packing and the like.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
