"""The fixed linear rule that stands in for a fitted model in the checks."""

from monthloom.operators.forecast import Rule
from monthloom.plans.sql import RULE_INTERCEPT, RULE_TERMS

RULE = Rule(dict(RULE_TERMS), RULE_INTERCEPT)
