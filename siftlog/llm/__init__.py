"""Training-data operators: each module holds one operator; ``queries`` holds the registered queries."""
