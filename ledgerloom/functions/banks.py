"""Bank-name classification from free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bank and the words that name it, tried in this order.
BANK_PATTERNS = {
    "HSBC": ["hsbc"],
    "Standard Chartered": ["standard", "scb"],
    "Citibank": ["citi"],
    "JPMorgan Chase": ["chase", "jpmorgan"],
    "Bank of America": ["bank of america", "bofa"],
    "Wells Fargo": ["wells"],
    "Deutsche Bank": ["deutsche"],
    "Barclays": ["barclays"],
    "BNP Paribas": ["bnp", "paribas"],
    "Credit Suisse": ["credit suisse"],
    "ING Bank": ["ing"],
    "Royal Bank": ["royal", "rbc"],
    "Commonwealth Bank": ["commonwealth", "cba"],
    "ANZ Bank": ["anz"],
    "National Bank": ["national", "nbk"],
    "First National": ["first national"],
    "Central Bank": ["central"],
    "Commercial Bank": ["commercial"],
    "Investment Bank": ["investment"],
    "International Bank": ["international"],
}


def bank_of(c: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """First bank one of whose words starts a word of the text, else null.

    Words must begin at a word boundary, and words of up to three letters must also
    end there: `ing` would otherwise be found in most English text.
    """
    text = F.lower(c)
    result = F.lit(None).cast("string")
    for bank, words in reversed(list((patterns or BANK_PATTERNS).items())):
        parts = [w + "([^a-z0-9]|$)" if len(w) <= 3 else w for w in words]
        found = text.rlike("(^|[^a-z0-9])(" + "|".join(parts) + ")")
        result = F.when(found, F.lit(bank)).otherwise(result)
    return result
