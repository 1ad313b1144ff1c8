"""Registered queries: each plan module runs its operators over the driver tables and states the oracle SQL."""
