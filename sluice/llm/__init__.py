"""Training-data operators: ten stages from language identification to binary token output."""
