"""DataFrame operators: votes, decisions, scores, ledgers, ranks, sets, statistics, schedules, searches and audits."""
