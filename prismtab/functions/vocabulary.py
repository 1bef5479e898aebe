"""The transaction words that decide how an amount counts."""

SALE_VALUES = ("SALE", "SALES", "SELL", "SOLD", "INCOME", "REVENUE", "PAID")
EXPENSE_VALUES = ("EXPENSE", "EXPENSES", "COST", "COSTS", "SPENDING")
CREDIT_VALUES = ("UDHAAR", "CREDIT", "OUTSTANDING", "DEBT", "CUSTOMER DEBT")
REFUND_VALUES = ("REFUND", "RETURN", "RETURNS")

# Ledger reports use exactly three words.
LEDGER_SALES = "SALES"
LEDGER_EXPENSE = "EXPENSE"
LEDGER_CREDIT = "UDHAAR"
