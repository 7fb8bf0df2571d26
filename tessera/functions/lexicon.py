"""Terms that mark finance text, and the patterns made from them."""

from __future__ import annotations

import re

# Matched at a word start, whatever the case; a trailing * stands for any word ending.
PROMPT_TERMS = (
    "invest", "invests", "invested", "investing", "investment*", "investor*", "financ*", "dividend*", "mortgag*", "loan*", "debt*", "tax", "taxes", "taxed", "taxable", "taxation",
    "retire*", "pension*", "broker*", "portfolio*", "stock*", "bond", "bonds", "shareholder*", "equity", "equities", "inflation", "interest rate*", "compound interest",
    "credit card*", "credit score*", "credit report*", "credit union*", "bank account*", "banking", "savings", "budget*", "insur*", "annuit*", "salary", "salaries", "income*", "expense*",
    "deduct*", "refinanc*", "money", "currenc*", "forex", "crypto*", "bitcoin*", "trading", "trader*", "asset*", "liabilit*", "revenue*", "profit*", "accounting", "accountant*", "earnings",
    "valuation*", "capital gain*", "fund", "funds", "etf*", "ira", "iras", "401(k)", "401k", "roth", "apr", "paycheck*", "wage*", "econom*", "wealth management", "wealthy", "cash", "debit*",
    "lender*", "lending", "brokerage*", "securities", "payment*", "net worth", "call option*", "put option*", "stock option*", "share option*", "options trading", "option pric*",
    "market order*", "limit order*", "stop loss*", "stop-loss*", "trailing stop*", "price target*", "market cap", "market capitali*", "venture capital*", "working capital", "capital loss*",
    "hedging", "hedge fund*", "bollinger", "bid price*", "ask price*", "espp", "adr", "adrs", "cpa", "cpas", "buying shares", "buy shares", "selling shares", "sell shares", "my shares",
    "shares in", "shares of", "shares outstanding", "cashier* check*", "personal check*", "depositing a check", "deposit a check", "direct deposit*", "wire transfer*", "exchange rate*",
    "closing cost*", "real estate", "foreclos*", "landlord*", "rental propert*", "rental yield*", "medical bill*", "hourly pay", "pay rise*", "pay raise*",
)
# These count besides in an answer to a finance prompt.
ANSWER_TERMS = (
    "wealth*", "pay", "pays", "paid", "paying", "bank*", "interest", "credit*", "account*", "deposit*", "check", "checks", "checking", "cheque*", "share", "shares", "price*", "cost*", "fee", "fees",
    "earn*", "market*", "dollar*", "cents", "afford*", "sell*", "sold", "buy*", "bought", "rent*", "bill", "bills", "claim*", "spend*", "spent", "owe*", "business*", "contract*", "order*",
)
# What "bank" may not follow directly.
NOT_BEFORE_BANK = ("river ", "food ", "blood ", "west ", "memory ", "data ", ", ", ": ")
# The currency signs, and within how many characters "interest" must stand beside a rate, an earning or an amount.
CURRENCY = "[$£€]"
INTEREST_REACH = 40

#: Java: letters in either case, and \w, \b, \d and \s over Unicode.
FLAGS = "(?iuU)"


def escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)


def alternatives(terms: tuple[str, ...], before: str, inside: str, after: str) -> str:
    """One alternation of all terms in their order, given what stands for a word's start, a word's rest and its end."""
    whole = [escaped(t[:-1]) + inside if t.endswith("*") else escaped(t) + after for t in terms]
    return before + "(?:" + "|".join(whole) + ")"


def term_pattern(terms: tuple[str, ...]) -> str:
    """For Java: a term that neither starts nor, without *, ends inside a word."""
    return alternatives(terms, r"(?<!\w)", r"\w*", r"(?!\w)")


# The patterns of a bank, an amount, a large amount, and interest beside a rate, an earning or an amount.
BANK = "".join(f"(?<!{x})" for x in NOT_BEFORE_BANK) + r"(?<!\w)bank(?:s|er|ers)?(?!\w)(?!\s*,)"
AMOUNT = rf"{CURRENCY}\s?\d"
LARGE_AMOUNT = rf"{CURRENCY}\s?(?:\d{{1,3}}(?:,\d{{3}})+|\d+(?:\.\d+)?\s?k)(?!\w)"
SAME_SENTENCE = rf"[^.?!\n]{{0,{INTEREST_REACH}}}?"
INTEREST = (
    rf"(?<!\w)interest(?!\w)(?={SAME_SENTENCE}(?:\brate|\bearn|{AMOUNT}|\d\s?%))"
    rf"|(?:\brate|\bearn\w*|{AMOUNT}){SAME_SENTENCE}(?<!\w)interest(?!\w)"
)
PROMPT_PATTERNS = tuple(FLAGS + p for p in (term_pattern(PROMPT_TERMS), BANK, INTEREST, LARGE_AMOUNT))
ANSWER_PATTERN = FLAGS + "(?:" + term_pattern(PROMPT_TERMS + ANSWER_TERMS) + "|" + AMOUNT + ")"
