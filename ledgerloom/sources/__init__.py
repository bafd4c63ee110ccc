"""Reading ledgers, statements and keyword files; stored results and exports."""
