"""Where blocks, transactions and logs come from."""
