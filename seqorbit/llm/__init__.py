"""Operators of a training-data pipeline (near-dedup, extraction, language ID,
decontamination, mixing).  Nothing else in the library imports this package;
``__spark_entry__.py`` adds its queries when it can be imported."""
