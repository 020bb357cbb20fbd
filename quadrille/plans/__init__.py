"""Rules, closure plans, rulesets and the quad store."""
