"""JSON Lines, vocabulary and policy sources, sinks, and a seeded source of labelled documents."""
