"""Training-data operators: decontamination, de-duplication, tokenisation, quality, licences.

Nothing outside this package imports it.
"""
