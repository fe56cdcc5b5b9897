"""Operators for preparing training text: deduplication, decontamination,
extraction, chat formatting, quality scoring and tokenisation."""
